"""All registered queries."""

from __future__ import annotations

from panelwise.plans import model_queries, prep_queries, score_queries, train_queries

QUERIES = {**prep_queries.QUERIES, **score_queries.QUERIES, **train_queries.QUERIES, **model_queries.QUERIES}
