"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .classlm import op9_classlm
from .decontaminate import SQL as DECONTAMINATE_SQL
from .decontaminate import op7_decontaminate
from .language import op2_language
from .neardup import SQL as NEARDUP_SQL
from .neardup import op6_neardup
from .neighbours import SQL as NEIGHBOURS_SQL
from .neighbours import op3_neighbours
from .pieces import op4_pieces
from .pii import op10_pii
from .secrets import op5_secrets
from .suffixes import op8_suffixes
from .toxicity import op1_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_language, op3_neighbours, op4_pieces, op5_secrets, op6_neardup, op7_decontaminate, op8_suffixes, op9_classlm, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op3_neighbours": NEIGHBOURS_SQL, "op6_neardup": NEARDUP_SQL, "op7_decontaminate": DECONTAMINATE_SQL}
