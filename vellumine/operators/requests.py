"""Requests to convert a file: the engines, routes and targets that each one has.

``engines``, ``routes`` and ``formats`` are constant tables of the program (``sources.formats``),
a row for each pair of formats at most, so they are broadcast. Requests are never shuffled but
for sums. A request whose formats are null, unknown or equal has no engine and no route.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.rules import usable


# The words of a report on a request that failed, how many attempts it names, and what may help by target.
FAILED, TRIED, ATTEMPTS = " 변환에 실패했습니다.", "시도한 방법:", 4
HINTS = {"hwp": "참고: .hwp 대신 .hwpx로 저장하세요.", "doc": "LibreOffice를 설치하세요.", "xls": "LibreOffice를 설치하세요."}


def _named(array: Column, by: str) -> Column:
    """The items of an array joined by ``by``; null for none."""
    return F.nullif(F.array_join(array, by), F.lit(""))


def with_abilities(files: DataFrame, formats: DataFrame, format: str = "format") -> DataFrame:
    """``files`` with can_read and can_write of their format, false where it is unknown."""
    known = formats.select(F.col("format").alias(format), "can_read", "can_write")
    met = files.join(F.broadcast(known), format, "left")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("can_read", "can_write")})


def with_engine(requests: DataFrame, direct: DataFrame) -> DataFrame:
    """``requests`` (src, dst) with the first engine that converts directly, else null."""
    return requests.join(F.broadcast(direct), ["src", "dst"], "left")


def with_engines(requests: DataFrame, engines: DataFrame, allowed: Callable[[Column], Column] | None = None, name: str = "engines") -> DataFrame:
    """``requests`` with all engines of their pair, by priority and name, joined by ``>``.

    ``allowed`` tells of an engine whether a request may use it.
    """
    pairs = engines.groupBy("src", "dst").agg(F.sort_array(F.collect_set(F.struct("priority", "engine"))).alias("able"))
    met = requests.join(F.broadcast(pairs), ["src", "dst"], "left")
    names = F.transform("able", lambda e: e["engine"])
    if allowed is not None:
        names = F.filter(names, allowed)
    return met.withColumn(name, _named(names, ">")).drop("able")


def with_usable_engines(requests: DataFrame, engines: DataFrame, external: str = "external", forced: str = "forced") -> DataFrame:
    """The engines that a request may use: its columns tell whether others than the built-in one, or one alone."""
    return with_engines(requests, engines, lambda e: usable(e, F.col(external), F.col(forced)), "usable")


def with_route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """``requests`` with hops and route (formats joined by ``>``), null where nothing leads there."""
    known = routes.select("src", "dst", F.col("hops").cast("long").alias("hops"), _named(F.col("path"), ">").alias("route"))
    return requests.join(F.broadcast(known), ["src", "dst"], "left")


def with_targets(files: DataFrame, routes: DataFrame, formats: DataFrame, format: str = "format") -> DataFrame:
    """``files`` with the writable formats that theirs leads to, sorted and joined by commas."""
    writable = formats.where("can_write").select(F.col("format").alias("dst"))
    reached = routes.join(F.broadcast(writable), "dst", "left_semi").groupBy(F.col("src").alias(format))
    known = reached.agg(_named(F.sort_array(F.collect_set("dst")), ",").alias("targets"))
    return files.join(F.broadcast(known), format, "left")


def pair_grid(requests: DataFrame, names: list[str], states: dict[str, str], state: str = "state") -> DataFrame:
    """For each source format the requests for each target of ``names`` and in each of ``states``, in one sum."""
    cells = [F.count_if(F.col("dst") == n).alias(n) for n in names]
    return requests.groupBy("src").agg(*cells, *(F.count_if(F.col(state) == s).alias(n) for n, s in states.items()))


def sorted_formats(files: DataFrame, group: str, format: str = "format") -> DataFrame:
    """The formats of each group of files, once each and sorted; null for a group without known ones."""
    return files.groupBy(group).agg(_named(F.sort_array(F.collect_set(format)), ",").alias("formats"))


def failure_text(src: Column, dst: Column, errors: Column, external: Column) -> Column:
    """A report on a request that no engine could do: its formats, the first attempts' ``errors``, and what may help.

    Binary Word files need an external engine, whatever they are converted to. Null errors are none.
    """
    hint = F.when((src == "doc") & ~F.coalesce(external, F.lit(False)) & (dst != "hwp"), HINTS["doc"])
    for target, words in HINTS.items():
        hint = F.when(dst == target, words).otherwise(hint)
    head = F.concat(F.upper(src), F.lit(" → "), F.upper(dst), F.lit(FAILED))
    named = F.transform(F.slice(errors, 1, ATTEMPTS), lambda e: F.concat(F.lit("  "), e))
    tried = F.when(F.size(errors) > 0, F.concat(F.array(F.lit(TRIED)), named)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), tried, F.array_compact(F.array(hint))), "\n")
