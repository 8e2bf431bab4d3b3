"""What may be said of a product at a glance: six signals, each a decision table over facts about it; the first row whose condition holds speaks.

Conditions and labels are SQL over these facts: disclosure (disclosed, partial, not_disclosed, unchecked), items and flagged (numbers), checked_on, recalls (number), recalled_on, vetted, food,
organic and non_gmo (status of a record: certified or verified, another word, or null), organic_on, non_gmo_on, claim (certified, claimed or null), claim_on, names_gluten, traces_gluten,
grains (number of gluten grains in the list), maker, parent. A fact that is null holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNABLE = "NOT coalesce(vetted, false)"
CLAIMS = "coalesce(claim IN ('certified', 'claimed'), false)"

#: condition, state, label (SQL), date (SQL) of each row of each signal.
TABLES = {
    "flagged": [
        ("disclosure IS NULL OR disclosure = 'unchecked'", "unchecked", "'Not checked'", "NULL"),
        ("disclosure = 'not_disclosed'", "unchecked", "'Not disclosed'", "checked_on"),
        ("disclosure = 'partial' AND flagged = 0", "unchecked", "'List cut off'", "checked_on"),
        ("disclosure = 'partial'", "open", "concat(flagged, '+ flagged')", "checked_on"),
        ("flagged = 0", "confirmed", "'None flagged'", "checked_on"),
        ("true", "open", "concat(flagged, ' flagged')", "checked_on"),
    ],
    "recalls": [
        ("recalls > 0", "recall", "concat('Recalled', coalesce(concat(' ', year(recalled_on)), ''))", "recalled_on"),
        (UNABLE, "unchecked", "'Not checked'", "NULL"),
        ("true", "confirmed", "'None for this product'", "NULL"),
    ],
    "organic": [
        ("NOT food", "not_applicable", "'Does not apply'", "NULL"),
        ("organic = 'certified'", "confirmed", "'Maker certified'", "organic_on"),
        ("organic IS NOT NULL", "nothing", "'Not current'", "organic_on"),
        (UNABLE, "unchecked", "'Not checked'", "NULL"),
        ("true", "nothing", "'Not certified'", "NULL"),
    ],
    "non_gmo": [
        ("non_gmo = 'verified'", "confirmed", "'Non-GMO'", "non_gmo_on"),
        ("non_gmo IS NOT NULL", "nothing", "'Not current'", "non_gmo_on"),
        (UNABLE, "unchecked", "'Not checked'", "NULL"),
        ("true", "nothing", "'Not verified'", "NULL"),
    ],
    "gluten": [
        ("NOT food", "not_applicable", "'Does not apply'", "NULL"),
        (f"{CLAIMS} AND grains > 0", "open", "'Label conflicts'", "claim_on"),
        (f"{CLAIMS} AND traces_gluten", "confirmed", "concat(initcap(claim), ', shared line')", "claim_on"),
        (CLAIMS, "confirmed", "initcap(claim)", "claim_on"),
        ("grains > 0", "nothing", "'Contains gluten'", "checked_on"),
        ("names_gluten OR traces_gluten", "open", "'May contain'", "claim_on"),
        ("claim_on IS NULL", "unchecked", "'Not checked'", "NULL"),
        ("true", "nothing", "'Not declared'", "claim_on"),
    ],
    "owner": [("true", "ownership", "coalesce(parent, maker)", "NULL")],
}


def decision_sql(name: str) -> str:
    """The table as one SQL expression, a struct of state, label and as_of."""
    rows = " ".join(f"WHEN {c} THEN named_struct('state', '{state}', 'label', {label}, 'as_of', CAST({date} AS DATE))" for c, state, label, date in TABLES[name])
    return f"CASE {rows} END"


def signal(name: str) -> Column:
    """The table as a Column: struct of state, label and as_of."""
    out = F.lit(None)
    for condition, state, label, date in reversed(TABLES[name]):
        said = F.struct(F.lit(state).alias("state"), F.expr(label).alias("label"), F.expr(date).cast("date").alias("as_of"))
        out = F.when(F.expr(condition), said).otherwise(out)
    return out
