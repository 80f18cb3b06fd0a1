"""gatecast: departure-time (pushback) features and models as Spark jobs.

Everything is expressed with the DataFrame / SQL / MLlib / Structured
Streaming APIs so Catalyst and AQE choose the physical plan.
"""

__all__ = ["session", "schemas"]
