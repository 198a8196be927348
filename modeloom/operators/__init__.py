"""Contraction, combination, hooks and views."""

from modeloom.operators.best import best_rows, contract_best
from modeloom.operators.blocked import Blocked, contract_blocked
from modeloom.operators.combine import combine, combine_multi
from modeloom.operators.contract import contract, contract_many, einsum, outer, reduce_modes, scalar
from modeloom.operators.hooks import apply_hook
from modeloom.operators.masked import contract_masked, diagonal, trace
from modeloom.operators.ranges import as_of, contract_within
from modeloom.operators.reductions import LOG_SUM_EXP, VARIANCE, Reduction, reduce_with
from modeloom.operators.shares import einsum_shares
from modeloom.operators.skew import contract_skewed
from modeloom.operators.sliding import moving, stencil
from modeloom.operators.views import delinearise, linearise, permute, regroup, reshape, slice_modes, subview_tile, tile_view, untile

__all__ = ["LOG_SUM_EXP", "VARIANCE", "Blocked", "Reduction", "apply_hook", "as_of", "best_rows", "combine", "combine_multi", "contract", "contract_best", "contract_blocked", "contract_many", "contract_masked", "contract_skewed", "contract_within", "delinearise", "diagonal", "einsum", "einsum_shares", "linearise", "moving", "outer", "permute", "reduce_modes", "reduce_with", "regroup", "reshape", "scalar", "slice_modes", "stencil", "subview_tile", "tile_view", "trace", "untile"]
