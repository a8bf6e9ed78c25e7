"""Plain and same-row quoted triples maps are stateless, so they run over a stream as they do over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.compiler import Compiler, Options
from ..plans.model import Mapping


def stream_statements(mapping: Mapping, streams: dict[str, DataFrame]) -> DataFrame:
    """Statements of a mapping over streaming sources, by source name; repeats are kept.

    Parent joins and joins of quoted maps need a static other side, which may stand in ``streams`` as a plain DataFrame.
    """
    return Compiler(mapping, lambda source: streams[source.name], Options(dedup=False)).graph_of()
