from tallyshop.operators.facts import (
    class_totals,
    item_totals,
    order_totals,
    product_totals,
    save_item_totals,
    valid_lines,
)
from tallyshop.operators.lookup import fits_broadcast, lookup
from tallyshop.operators.ordering import global_row_number, ntile_global, rank_within, top_n
from tallyshop.operators.periods import growth_pct, running_total
from tallyshop.operators.quality import fk_violations, null_violations, pk_violations, validate
from tallyshop.operators.relations import count_lookup, team_rollup, unmatched, with_manager
from tallyshop.operators.stats import (
    count_distinct_ids,
    fulfilment,
    group_median,
    pct_of_total,
    segment_by_count,
    status_pivot,
)

__all__ = [
    "class_totals",
    "count_distinct_ids",
    "count_lookup",
    "fits_broadcast",
    "fk_violations",
    "fulfilment",
    "global_row_number",
    "group_median",
    "growth_pct",
    "item_totals",
    "lookup",
    "ntile_global",
    "null_violations",
    "order_totals",
    "pct_of_total",
    "pk_violations",
    "product_totals",
    "rank_within",
    "running_total",
    "save_item_totals",
    "segment_by_count",
    "status_pivot",
    "team_rollup",
    "top_n",
    "unmatched",
    "validate",
    "valid_lines",
    "with_manager",
]
