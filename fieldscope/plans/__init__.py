"""Plan patterns that hold when one key owns a large share of the rows."""

from fieldscope.plans.ordered import bucket_of, chunk_of, previous_row, running_total, split_points, transition_totals
from fieldscope.plans.quantiles import nearest_rank
from fieldscope.plans.topk import top_per_key

__all__ = ["bucket_of", "chunk_of", "nearest_rank", "previous_row", "running_total", "split_points", "top_per_key", "transition_totals"]
