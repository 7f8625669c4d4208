"""Query plans: fixtures over the driver tables, registered queries, the compare plan."""

import importlib

_MODULES = ["stats_queries", "similarity_queries", "prep_queries", "nn_queries", "score_queries", "encode_queries", "model_queries", "synth_queries", "misc_queries", "mixture_queries"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"fidspark.plans.{m}")
