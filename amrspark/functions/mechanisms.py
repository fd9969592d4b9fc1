"""Which genes and mutations mean which resistance mechanism, as column expressions.

Each flag reads one row of the call table: gene, is_amr, is_point, is_disrupt, drug_subclass.
Symbol families and subclasses below are fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol prefixes, lower case (fixed values).
PREFIXES = {
    "rmtase": ("rmt",),
    "ame": ("aac(", "aph(", "ant("),
    "pmqr": ("qnr", "qepa", "oqx"),
    "sul": ("sul",),
    "dfr": ("dfr",),
    "qrdr": ("gyra_", "gyra-", "parc_", "parc-"),
    "porin": ("ompk",),
}
RMTASE_NAME = "arma"
PMQR_INSIDE = "aac(6')-ib-cr"
CARBAPENEM = "CARBAPENEM"
CEPHALOSPORIN = "CEPHALOSPORIN"


def _starts(low: Column, family: str) -> Column:
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in PREFIXES[family]])


def flags(
    gene: str = "gene",
    amr: str = "is_amr",
    point: str = "is_point",
    disrupt: str = "is_disrupt",
    subclass: str = "drug_subclass",
) -> dict[str, Column]:
    low = F.lower(F.col(gene))
    is_amr, is_point, is_disrupt = F.col(amr), F.col(point), F.col(disrupt)
    sub = F.coalesce(F.col(subclass), F.lit(""))
    return {
        "carbapenemase": is_amr & (sub == CARBAPENEM),
        "esbl_ampc": is_amr & (sub == CEPHALOSPORIN),
        "cephalosporin": is_amr & sub.isin(CEPHALOSPORIN, CARBAPENEM),
        "rmtase": is_amr & ((low == RMTASE_NAME) | _starts(low, "rmtase")),
        "ame": is_amr & _starts(low, "ame"),
        "pmqr": is_amr & (_starts(low, "pmqr") | low.contains(PMQR_INSIDE)),
        "sul": is_amr & _starts(low, "sul"),
        "dfr": is_amr & _starts(low, "dfr"),
        "qrdr": is_point & _starts(low, "qrdr"),
        "porin": is_disrupt & _starts(low, "porin"),
    }
