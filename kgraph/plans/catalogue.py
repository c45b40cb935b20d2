"""Named queries and their SQL."""

from kgraph.plans import curriculum, curriculum_sql, records

QUERIES: dict = {**records.QUERIES, **curriculum.QUERIES}
ORACLES: dict = {**records.ORACLES, **curriculum_sql.ORACLES}
FLAGSHIP = "observation_top5"
