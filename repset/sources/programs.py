"""External programs: which of them work here, and runs of one command for each row."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: fixed values: the programs whose outputs the readers know, with arguments that print something and end well
PROGRAMS = {"mash": ["--version"], "nucmer": ["--version"], "delta-filter": ["-h"], "show-snps": ["-h"], "fastANI": ["-h"], "skani": ["--version"], "ANIcalculator": ["-version"], "nsimscan": ["-h"], "prodigal": ["-v"], "checkm": ["-h"], "centrifuge": ["--version"]}


def working(name: str, arguments: list[str]) -> tuple[str, bool, str | None]:
    """(name, whether it runs, where it is)"""
    where = shutil.which(name)
    if where is None:
        return name, False, None
    try:
        return name, subprocess.run([where, *arguments], capture_output=True, timeout=60).returncode in (0, 1), where
    except (OSError, subprocess.TimeoutExpired):
        return name, False, where


def report(spark: SparkSession, programs: dict[str, list[str]] | None = None) -> DataFrame:
    """``program, works, location`` on the driver's machine."""
    rows = [working(n, a) for n, a in (PROGRAMS if programs is None else programs).items()]
    return spark.createDataFrame(rows, "program string, works boolean, location string")


def run_each(rows: DataFrame, command: Callable[[dict], list[str]], timeout: float = 3600) -> DataFrame:
    """The columns of ``rows`` with ``code, out, err`` of the command that ``command`` makes of each row, run where the
    row is. A failure to start is code -1; Spark runs the rows of a lost executor again, so commands must
    stand to be repeated."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", code int, out string, err string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = []
            for row in part.to_dict("records"):
                try:
                    p = subprocess.run(command(row), capture_output=True, text=True, timeout=timeout)
                    got.append((p.returncode, p.stdout, p.stderr))
                except (OSError, subprocess.TimeoutExpired) as e:
                    got.append((-1, "", str(e)))
            yield part.assign(code=[g[0] for g in got], out=[g[1] for g in got], err=[g[2] for g in got])

    return rows.mapInPandas(run, ddl)
