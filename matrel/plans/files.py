"""Queries that write files and read them again, and pictures read back from their bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.plans import fixtures as fx
from matrel.plans.fixtures import sql
from matrel.relation import Matrix
from matrel.sources import matrix_market as mm
from matrel.sources import scratch, spy, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql(oracle)


def _whole(a: Matrix) -> DataFrame:
    return a.df.select("i", "j", F.col("v").cast("bigint").alias("v"))


def _again(write: Callable[[Matrix, str], None], read: Callable[[SparkSession, str], Matrix]) -> Query:
    """The square fixture, written and read again."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        path = scratch.folder(s, "file")
        write(fx.square(s, sf), path)
        return _whole(read(s, path))

    return run


_stored = "SELECT i, j, v FROM q"
_dense = "SELECT t.i, s.j, CAST(coalesce(q.v, 0) AS BIGINT) AS v FROM range(48) t(i) CROSS JOIN range(48) s(j) LEFT JOIN q ON q.i = t.i AND q.j = s.j"
add("mm_write_sparse", _again(mm.mm_write_sparse, mm.mm_read), _stored)
add("mm_write", _again(mm.mm_write, mm.mm_read_dense), _dense)
add("mm_read_array", _again(mm.mm_write, mm.mm_read), "SELECT i, j, v FROM q WHERE v <> 0")
add("mm_read_gzip", _again(lambda a, path: mm.mm_write_sparse(a, path, "gzip"), mm.mm_read), _stored)
add("write_dense", _again(text.write_dense, text.read_dense), _dense)
add("write_sparse", _again(text.write_sparse, lambda s, path: text.read_sparse(s, path, 48, 48)), _stored)


def _by_name(s: SparkSession, sf: str) -> DataFrame:
    path = scratch.folder(s, "named")
    mm.mm_write_sparse(fx.square(s, sf), f"{path}/west0132.mtx")
    return _whole(mm.by_name(s, "west0132", path))


add("matrix_by_name", _by_name, _stored)
add("matrix_names", lambda s, sf: mm.names(s).agg(F.count("name").alias("n"), F.min("kappa").alias("low"), F.max("kappa").alias("high")).withColumn("steam1", F.lit(mm.kappa("steam1"))), "SELECT CAST(20 AS BIGINT) AS n, 10.0::DOUBLE AS low, 1e16::DOUBLE AS high, 28275010.0::DOUBLE AS steam1")

_BANNERS = ("%%MatrixMarket matrix coordinate real general", "%%MatrixMarket matrix array real symmetric", "%%MatrixMarket matrix array integer general", "%%MatrixMarket matrix coordinate complex general", "%%MatrixMarket tensor array real general", "%%MatrixMarket matrix coordinate real hermitian", "matrix")


def _banners(s: SparkSession, sf: str) -> DataFrame:
    def parsed(line: str) -> tuple[bool | None, bool | None]:
        try:
            return mm.parse_banner(line)
        except mm.MatrixMarketError:
            return None, None

    return s.createDataFrame([(k, *parsed(x)) for k, x in enumerate(_BANNERS)], "k long, coordinate boolean, symmetric boolean")


add("parse_mm_banner", _banners, "SELECT k, CASE WHEN k < 3 THEN k = 0 END AS coordinate, CASE WHEN k < 3 THEN k = 1 END AS symmetric FROM range(7) t(k)")


def _pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG file of bytes without filters."""
    import struct
    import zlib

    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            w, h, _, colour = struct.unpack(">IIBB", data[at + 8 : at + 18])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)[:, 1:]
    return rows.reshape(h, w, 3 if colour == 2 else 1)


def _picture(draw: Callable[[Matrix, str], None], of: Callable[[SparkSession, str], Matrix]) -> Query:
    """Pixels that aren't white: rows ``y, x, r, g, b`` of a colour picture, ``y, x`` of a grey one. Pictures are files of the driver."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        import tempfile
        from pathlib import Path

        with tempfile.TemporaryDirectory() as here:
            draw(of(s, sf), f"{here}/a.png")
            p = _pixels(Path(f"{here}/a.png").read_bytes())
        y, x = np.nonzero((p != 255).any(axis=2))
        names = "".join(f", {c} long" for c in "rgb"[: p.shape[2]]) if p.shape[2] == 3 else ""
        return s.createDataFrame([(int(a), int(b), *(map(int, p[a, b]) if names else ())) for a, b in zip(y, x, strict=True)], "y long, x long" + names)

    return run


_channel = lambda k: f"CAST(trunc(255 * least(greatest(1.5 - abs(4 * t - {k}), 0), 1)) AS BIGINT)"
_colours = lambda cells: f"SELECT y, x, {_channel(3)} AS r, {_channel(2)} AS g, {_channel(1)} AS b FROM (SELECT y, x, CASE WHEN high > low THEN (m - low) / (high - low) ELSE 1 END AS t FROM (SELECT y, x, CAST(m AS DOUBLE) AS m, CAST(min(m) OVER () AS DOUBLE) AS low, CAST(max(m) OVER () AS DOUBLE) AS high FROM {cells})) WHERE NOT ({_channel(3)} = 255 AND {_channel(2)} = 255 AND {_channel(1)} = 255)"
_shape = "(SELECT rows, cols, CAST(greatest(1, round(rows * scale)) AS BIGINT) AS h, CAST(greatest(1, round(cols * scale)) AS BIGINT) AS w FROM (SELECT rows, cols, least(1.0::DOUBLE, 20.0::DOUBLE / greatest(rows, cols)) AS scale FROM (SELECT (SELECT max(s_suppkey) + 1 FROM supplier) AS rows, (SELECT max(p_partkey) + 1 FROM part) AS cols)))"
_cells = f"(SELECT CAST(a.i * h // rows AS BIGINT) AS y, CAST(a.j * w // cols AS BIGINT) AS x, CAST(count(*) AS BIGINT) AS n, CAST(max(a.v) AS DOUBLE) AS m FROM a, {_shape} WHERE a.v <> 0 GROUP BY 1, 2)"
add("spy", _picture(spy.spy, fx.square), "SELECT i AS y, j AS x FROM q WHERE v <> 0")
add("spy_magnitude", _picture(spy.spy_magnitude, fx.square), _colours("(SELECT i AS y, j AS x, v AS m FROM q WHERE v <> 0)"))
add("spy_density", _picture(lambda a, path: spy.spy_density(a, path, edge=20), fx.quantities), _colours(f"(SELECT y, x, n AS m FROM {_cells})"))
add("spy_grid", lambda s, sf: spy.build_grid(fx.quantities(s, sf), 20), f"SELECT y, x, n, m FROM {_cells}")
add("print_rows", lambda s, sf: text.print_lines(fx.square(s, sf)), "SELECT i, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY j) AS line FROM (SELECT t.i, s.j, coalesce(q.v, 0) AS v FROM range(48) t(i) CROSS JOIN range(48) s(j) LEFT JOIN q ON q.i = t.i AND q.j = s.j) GROUP BY i")
