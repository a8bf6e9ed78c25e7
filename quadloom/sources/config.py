"""Runs that a configuration file describes."""

from __future__ import annotations

import time
from configparser import ConfigParser, ExtendedInterpolation
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.compiler import Compiler, Options, distinct_statements
from ..plans.document import load_mapping
from .readers import reader
from .sinks import write_statements


def run(spark: SparkSession, path: str) -> dict[str, str]:
    """Materialises each dataset of an INI file; returns the paths written and prints the time it took.

    ``[datasets]``: ``number_of_datasets``, ``output_folder``, ``all_in_one_file`` (then ``name``), ``remove_duplicate``,
    ``reuse_join_inputs`` (keep inputs that several maps join until the graph is written), ``single_file`` (one file a
    graph, for small ones), ``valid_literals`` (escapes as N-Triples asks), ``main_directory``. ``[datasetN]``: ``name``,
    ``mapping``, ``encoding`` of its text files if it is known, and for databases ``url``, ``user``, ``password``,
    ``driver`` and the JDBC reader's partitioning options. Other keys steer the order of work elsewhere and are accepted;
    Spark plans that itself.
    """
    config = ConfigParser(interpolation=ExtendedInterpolation())
    with open(path, encoding="utf-8") as f:
        config.read_file(f)
    began, top = time.perf_counter(), config["datasets"]
    yes = lambda key: top.get(key, "no").lower() in ("yes", "true", "1")
    one = yes("all_in_one_file")
    options = Options(dedup=yes("remove_duplicate") and not one, persist=yes("reuse_join_inputs"), legacy_escapes=not yes("valid_literals"))
    folder, written, parts, compilers = top["output_folder"], {}, [], []
    for i in range(1, top.getint("number_of_datasets", 1) + 1):
        section = config[f"dataset{i}"]
        connection = {k: section[k] for k in ("url", "user", "password", "driver", "partitionColumn", "lowerBound", "upperBound", "numPartitions") if k in section}
        read = reader(spark, top.get("main_directory", ""), connection=connection, encoding=section.get("encoding"))
        compiler = Compiler(load_mapping(section["mapping"]), read, options)
        if one:
            parts.append(compiler.graph_of())
            compilers.append(compiler)
            continue
        written[section["name"]] = write_statements(compiler.graph_of(), folder, section["name"], yes("single_file"))
        compiler.release()
    if one:
        whole = reduce(DataFrame.unionByName, parts)
        written[top["name"]] = write_statements(distinct_statements(whole) if yes("remove_duplicate") else whole, folder, top["name"], yes("single_file"))
        for compiler in compilers:
            compiler.release()
    print(f"Materialised {len(written)} graphs in {time.perf_counter() - began:.1f} s")
    return written
