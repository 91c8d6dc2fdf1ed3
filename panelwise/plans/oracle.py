"""All SQL equivalents."""

from __future__ import annotations

from panelwise.plans import model_oracle, prep_oracle, score_oracle, train_oracle

ORACLE = {**prep_oracle.ORACLE, **score_oracle.ORACLE, **train_oracle.ORACLE, **model_oracle.ORACLE}
