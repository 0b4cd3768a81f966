"""Settings of a fit. Unknown keys are errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

PRIORITIES = ("bound", "objective", "curiosity", "entropy", "gini", "fifo", "random")
OBJECTIVES = ("acc", "bacc", "wacc", "f1", "auc", "pauc")


@dataclass(frozen=True)
class Config:
    regularization: float = 0.05
    upperbound: float = 0.0  # 0: none
    uncertainty_tolerance: float = 0.0  # stop once upper - lower bound is no more
    time_limit: float = 0.0  # seconds; 0: none
    model_limit: int = 1  # 0: no models
    precision_limit: int = 0  # significant digits of thresholds; 0: all
    worker_limit: int = 0  # tasks that solve subproblems at once; 0: as many as the cluster runs
    stack_limit: int = 0  # accepted, no meaning here
    tile_limit: int = 0  # accepted, no meaning here
    balance: bool = False
    costs: str = ""  # path of a cost matrix
    look_ahead: bool = True
    similar_support: bool = True
    feature_exchange: bool = True
    continuous_feature_exchange: bool = True
    cancellation: bool = True  # accepted: subproblems that can't win are closed in any case
    feature_transform: bool = True  # accepted: subproblems with equal rows are one in any case
    rule_list: bool = False
    non_binary: bool = False  # models in JSON have a child for each interval of a column
    verbose: bool = False  # say how the search goes, on standard error
    diagnostics: bool = False  # summary["diagnosis"] tells why a search didn't close
    model: str = ""
    timing: str = ""
    profile: str = ""
    trace: str = ""  # folder for the subproblems and links of the search
    tree: str = ""  # file for the best tree's paths; the bounds of all splits of its inner nodes go to this name and "-rivals"
    checkpoint: str = ""  # folder to which a search saves what it has solved (by levels: each level), and from which it goes on
    level_limit: int = 0  # levels that one call of a search by levels takes; 0: all
    objective: str = ""  # empty: additive costs
    w: float = 1.0
    theta: float = 1.0
    priority: str = "bound"  # which state a special search takes next
    max_leaves: int = 0  # of a special search's trees; 0: any
    max_depth: int = 0
    iteration_limit: int = 0  # states of a special search; 0: all
    init_cart: bool = False  # start a special search from a greedy tree
    null_policy: str = "reference"  # or sql
    local_cells: int = 2_000_000  # groups x predicates up to which the search runs on the driver
    task_cells: int = 200_000  # groups x predicates up to which a subproblem is solved in one task
    predicate_limit: int = 100_000  # distinct values that a codex may be made of

    def __post_init__(self) -> None:
        if self.objective and self.objective not in OBJECTIVES:
            raise ValueError(f"objective {self.objective!r} is none of {', '.join(OBJECTIVES)}")
        if self.priority not in PRIORITIES:
            raise ValueError(f"priority {self.priority!r} is none of {', '.join(PRIORITIES)}")
        if self.null_policy not in ("reference", "sql"):
            raise ValueError("null_policy is reference or sql")
        if self.regularization < 0:
            raise ValueError("regularization can't be negative")

    @classmethod
    def of(cls, given: Config | dict | str | None) -> Config:
        """From a dict, JSON text, or nothing."""
        if isinstance(given, cls):
            return given
        if isinstance(given, str):
            given = json.loads(given)
        given = dict(given or {})
        if wrong := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(wrong)}")
        return cls(**given)

    def as_json(self) -> str:
        return json.dumps(asdict(self), indent=2)
