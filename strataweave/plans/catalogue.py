"""All registered queries."""

from strataweave.plans import designs, draws, graphs, heldout, models, rendering, sampling, scoring, streams, text, triage, uncertainty

QUERIES: dict = {}
ORACLES: dict = {}
for part in (scoring, sampling, designs, draws, heldout, graphs, rendering, text, triage, uncertainty, streams, models):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
