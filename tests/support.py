"""A small data set in all forms, with the odd cases of each."""

from __future__ import annotations

import math
import sqlite3
from contextlib import closing
from pathlib import Path

import duckdb
import numpy as np

from eqtlake.sources.besd import MAGIC_3, MAGIC_3F

SNP_LINES = [
    "#chr id cM bp a1 a2 freq",
    "",
    "1 snA 0.1 100 A G 0.4",
    "three fields only",
    "1\tsnB\t0.2\t200\tC\tT\t0.2",
    "1 snC NA 300",
    "1 snD 0 NA A G 0.1",
    "X snE 0 400 A G NA",
    "1 snB 0 200 G T 0.3",
]
PROBE_LINES = [
    "# probes",
    "1 p0 0 150 G1 +",
    "1 p1 0 150 G2 -",
    "p9 too short",
    "X p2 0 350 G1 +",
    "1 p3 0 5000",
    "1 p1 0 100 NA +",
]
#: (probe row, snp row, beta, se): probe 1 has none, probe 0 has SNP 0 twice.
ROWS = [
    (0, 0, 0.5, 0.1),
    (0, 2, -0.25, 0.5),
    (0, 0, 0.125, 0.0),
    (2, 3, 1.5, 0.25),
    (2, 1, float("nan"), 1.0),
    (2, 9, 0.75, 0.25),
    (3, 1, 0.0, 1.0),
    (3, 4, 2.0, -9.0),
    (4, 0, 0.3, float("inf")),
    (4, 1, 0.7, 0.2),
]
N_SNPS, N_PROBES = 5, 5


def write_small_besd(rows: list[tuple], n_probes: int, path: str, kind: str = "3F") -> None:
    """A binary matrix from (probe, SNP, beta, se) in storage order."""
    by_probe = [[r[1:] for r in rows if r[0] == p] for p in range(n_probes)]
    ends = np.cumsum([0] + [len(own) for own in by_probe for _ in range(2)])
    snps = [s for own in by_probe for _ in range(2) for s, _, _ in own]
    values = [r[c] for own in by_probe for c in (1, 2) for r in own]
    head = np.array([MAGIC_3F], "<u4").tobytes() if kind == "3F" else np.array([MAGIC_3], "<u4").tobytes() + bytes(60)
    body = [np.array([len(snps)], "<u8"), ends.astype("<u8"), np.array(snps, "<u4"), np.array(values, "<f4")]
    Path(path).write_bytes(head + b"".join(x.tobytes() for x in body))


def make_files(folder: Path, kind: str = "3F") -> str:
    prefix = str(folder / "set")
    Path(f"{prefix}.esi").write_text("\n".join(SNP_LINES) + "\n")
    Path(f"{prefix}.epi").write_text("\n".join(PROBE_LINES) + "\n")
    write_small_besd(ROWS, N_PROBES, f"{prefix}.besd", kind)
    return prefix


def make_sqlite(ds, path: str) -> str:
    """The data set ``ds`` with the facts of ROWS as an index in one SQLite file."""
    tables = {"esi": ds.snps, "epi": ds.probes, "besd_meta": ds.meta}
    with closing(sqlite3.connect(path)) as con, con:
        for name, df in tables.items():
            con.execute(f"CREATE TABLE {name} ({', '.join([f'{df.columns[0]} PRIMARY KEY', *df.columns[1:]])})")
            con.executemany(
                f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()]
            )
        con.execute("CREATE TABLE probe_data (probe_idx INTEGER PRIMARY KEY, snp_count, snp_indices, betas, ses)")
        for p in range(N_PROBES):
            own = [r[1:] for r in ROWS if r[0] == p]
            arrays = [np.array([r[c] for r in own], k).tobytes() for c, k in enumerate(("<i4", "<f4", "<f4"))]
            con.execute("INSERT INTO probe_data VALUES (?, ?, ?, ?, ?)", (p, len(own), *arrays))
    return path


def cdf(z: float) -> float:
    x = abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = 1.061405429
    for a in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + a
    erf = 1 - poly * t * math.exp(-x * x)
    return 0.5 * (1 + (erf if z >= 0 else -erf))


def p_value(beta: float, se: float) -> float:
    if not (math.isfinite(beta) and math.isfinite(se)) or se <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * (1 - cdf(abs(beta / se)))))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = path if path.is_file() else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def text_rows(rows: list[tuple]) -> list[tuple]:
    """Comparable rows: floats by repr, the rest by str, sorted."""

    def cell(x) -> str:
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """``df`` and the SQL have the same columns and the same rows."""
    names = sorted(df.columns)
    got = text_rows([tuple(r) for r in df.select(*names).collect()])
    result = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    assert sorted(d[0] for d in con.execute(f"DESCRIBE {sql}").fetchall()) == names
    want = text_rows(con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall())
    assert result is not None and got == want
