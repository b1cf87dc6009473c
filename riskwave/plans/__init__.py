from riskwave.plans.broadcast import bounded_broadcast
from riskwave.plans.lineage import cut_lineage

__all__ = ["bounded_broadcast", "cut_lineage"]
