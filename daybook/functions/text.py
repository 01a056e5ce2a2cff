"""Label normalisation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters a label may hold and their plain forms.
ACCENTED = "áéíóúüñ"
PLAIN = "aeiouun"


def slug(label: str) -> str:
    """Column-name form of a label; the driver-side twin of :func:`slug_column`."""
    folded = unicodedata.normalize("NFKD", label.lower())
    letters = "".join(c for c in folded if not unicodedata.combining(c))
    return "_".join(re.findall(r"[a-z0-9]+", letters))


def slug_column(column: str | Column) -> Column:
    """Lower-case a label, strip its accents and join its words with underscores."""
    plain = F.translate(F.lower(column), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", "_"), F.lit("_"))
