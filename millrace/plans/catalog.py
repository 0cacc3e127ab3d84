"""All queries of the core with their equivalent SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import contracts, graders, more, prepare, quantities, relational, rl, sequences, streams, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (rl, prepare, more, tokens, graders, relational, sequences, streams, quantities, contracts):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
