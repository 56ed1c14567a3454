"""Network-flow analytics as Spark DataFrame operators.

Flow, packet, syslog and IDS records go in; one-minute aggregates, ranked
traffic views, learned baselines, alerts, risk scores and planned
notifications come out.  Every operator takes and returns DataFrames, so
operators compose with ``DataFrame.transform`` and leave the physical plan to
Catalyst.
"""

from tidewire.params import Params

__all__ = ["Params"]
