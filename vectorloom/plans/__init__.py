from vectorloom.plans.records import ORACLES, QUERIES  # noqa: F401  (all of catalog, oracles and training, and its own)
