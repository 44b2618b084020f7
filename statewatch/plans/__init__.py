"""Plan building blocks shared by the operators."""

from statewatch.plans.draws import draw_index, draw_uniform
from statewatch.plans.durable import durable
from statewatch.plans.guards import bounded_model, require
from statewatch.plans.ordering import Placed, longest_group, place
from statewatch.plans.quantiles import quantiles

__all__ = [
    "Placed",
    "bounded_model",
    "draw_index",
    "draw_uniform",
    "durable",
    "longest_group",
    "place",
    "quantiles",
    "require",
]
