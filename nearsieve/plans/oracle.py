"""DuckDB twins, written against the contracts and not against the Spark code.

Fragments are common table expressions named after what they hold; ``with_``
puts the ones that a query needs in front of it.
"""

from __future__ import annotations

from nearsieve.config import MASK, KnnConfig


def mul(a: str, b: str | int) -> str:
    return f"(CAST((CAST({a} AS HUGEINT) * {b}) % 4294967296 AS BIGINT))"


def sets_sql(name: str = "sets", source: str = "SELECT DISTINCT l_orderkey AS id, l_partkey + 1 AS idx FROM lineitem") -> str:
    return f"{name} AS ({source})"


def grams_sql(table: str, key: str, n: int = 5) -> str:
    gram = f"substring(text, i, {n})"
    return f"""SELECT DISTINCT {key} AS id, CAST(concat('0x', substring(md5({gram}), 1, 8)) AS BIGINT) % 4294967295 + 1 AS idx
    FROM {table}, LATERAL (SELECT unnest(range(1, length(text) - {n} + 2)) AS i)"""


def hashes_sql(cfg: KnnConfig, sets: str, p: str = "") -> str:
    c = cfg.constants
    return f"""{p}h1 AS (SELECT id, idx, {mul("idx", c["feature"])} AS h FROM {sets}),
    {p}h2 AS (SELECT id, idx, {mul("xor(h, h >> 13)", 0x85EBCA6B)} AS h FROM {p}h1),
    {p}fh AS (SELECT id, idx, (({mul("h", "idx")} << 5) & {MASK}) >> {32 - cfg.address_bits} AS h FROM {p}h2)"""


def bins_sql(cfg: KnnConfig, p: str = "") -> str:
    return f"{p}bins AS (SELECT id, least(h // {cfg.width}, {cfg.bins - 1}) AS bin, min(h) AS h FROM {p}fh GROUP BY 1, 2)"


def dense_sql(cfg: KnnConfig, p: str = "") -> str:
    probe = mul(f"(((i + 1) << 10) + c)", cfg.constants["probe"])
    return f"""{p}ids AS (SELECT DISTINCT id FROM {p}bins),
    {p}donor AS (SELECT i AS bin, c AS attempt, ((({probe} << 3) & {MASK}) * {cfg.bins}) >> 32 AS donor FROM range({cfg.bins}) a(i), range(1, {cfg.attempts + 1}) b(c)),
    {p}empty AS (SELECT id, i AS bin FROM {p}ids, range({cfg.bins}) a(i) WHERE NOT EXISTS (SELECT 1 FROM {p}bins b WHERE b.id = {p}ids.id AND b.bin = i)),
    {p}lent AS (SELECT e.id, e.bin, arg_min(b.h, d.attempt) AS h FROM {p}empty e JOIN {p}donor d ON d.bin = e.bin JOIN {p}bins b ON b.id = e.id AND b.bin = d.donor GROUP BY 1, 2),
    {p}sig AS (SELECT id, bin, h FROM {p}bins UNION ALL SELECT e.id, e.bin, coalesce(l.h, {MASK}) FROM {p}empty e LEFT JOIN {p}lent l ON l.id = e.id AND l.bin = e.bin)"""


def address_sql(cfg: KnnConfig, p: str = "") -> str:
    factors = ", ".join(f"({i}, {r})" for i, r in enumerate(cfg.constants["bins"]))
    return f"""{p}g1 AS (SELECT s.id, s.bin, s.h, f.r, {mul("s.h", "f.r")} AS x FROM {p}sig s JOIN (VALUES {factors}) f(bin, r) ON f.bin = s.bin),
    {p}g2 AS (SELECT id, bin // {cfg.hashes} AS tbl, {mul("xor(xor(x, x >> 13), r)", "h")} AS g FROM {p}g1),
    {p}addr AS (SELECT id, CAST(tbl AS INTEGER) AS tbl, (((CAST(sum(g) AS BIGINT) & {MASK}) << 2) & {MASK}) >> {32 - cfg.address_bits} AS bucket FROM {p}g2 GROUP BY 1, 2)"""


def index_sql(cfg: KnnConfig, p: str = "") -> str:
    h = mul(f"((id + 1) & {MASK})", cfg.constants["id"])
    return f"""{p}idx AS (SELECT * FROM (SELECT tbl, bucket, CAST(row_number() OVER (PARTITION BY tbl, bucket ORDER BY xor({h}, {h} >> 16), id) - 1 AS INTEGER) AS slot, id,
      count(*) OVER (PARTITION BY tbl, bucket) AS n_seen FROM {p}addr) WHERE slot < {cfg.reservoir})"""


def built(cfg: KnnConfig, sets: str = "sets", p: str = "") -> list[str]:
    return [hashes_sql(cfg, sets, p), bins_sql(cfg, p), dense_sql(cfg, p), address_sql(cfg, p)]


PROBE = "cand AS (SELECT q.id AS qid, i.tbl, i.slot, i.id FROM addr q JOIN idx i ON i.tbl = q.tbl AND i.bucket = q.bucket WHERE q.id % 20 = 0 AND i.id <> q.id)"


def ranked_sql(k: int, name: str = "knn", source: str = "SELECT qid, id, count(*) AS n FROM cand GROUP BY 1, 2") -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) - 1 AS INTEGER) AS rank, id, n FROM ({source})) WHERE rank < {k})"


def sketch_sql(cfg: KnnConfig, keys: str, source: str, order: str, name: str = "cells") -> str:
    rows = " UNION ALL ".join(f"SELECT {keys}, {r} AS row, {mul(f'((item + 1) & {MASK})', m)} >> {32 - cfg.sketch_bits} AS cell, item, o FROM stream" for r, m in enumerate(cfg.constants["rows"]))
    step = """lambda c, x: CASE WHEN (CASE WHEN c.cnt > 0 THEN c.cnt + (CASE WHEN c.hh = x.hh THEN 1 ELSE -1 END) ELSE 0 END) = 0
      THEN {'hh': x.hh, 'cnt': CAST(1 AS BIGINT)} ELSE {'hh': c.hh, 'cnt': CAST(c.cnt + (CASE WHEN c.hh = x.hh THEN 1 ELSE -1 END) AS BIGINT)} END"""
    return f"""stream AS ({source}),
    spread AS ({rows}),
    {name}_ AS (SELECT {keys}, row, cell, list_reduce(list({{'hh': item, 'cnt': CAST(0 AS BIGINT)}} ORDER BY o), {step}, {{'hh': first(item ORDER BY o), 'cnt': CAST(0 AS BIGINT)}}) AS c FROM spread GROUP BY {keys}, row, cell),
    {name} AS (SELECT {keys}, row, cell, c.hh AS hh, c.cnt AS cnt FROM {name}_)"""


MERGE = """lambda a, b: CASE WHEN a.hh = b.hh THEN {'hh': a.hh, 'cnt': CAST(a.cnt + b.cnt AS BIGINT)}
  WHEN a.cnt > b.cnt THEN {'hh': a.hh, 'cnt': CAST(a.cnt - b.cnt AS BIGINT)} ELSE {'hh': b.hh, 'cnt': CAST(b.cnt - a.cnt AS BIGINT)} END"""


def merge_sql(name: str, source: str, keys: str, order: str) -> str:
    return f"""{name}_ AS (SELECT {keys}, row, cell, list_reduce(list({{'hh': hh, 'cnt': cnt}} ORDER BY {order}), {MERGE}) AS c FROM {source} GROUP BY {keys}, row, cell),
    {name} AS (SELECT {keys}, row, cell, c.hh AS hh, c.cnt AS cnt FROM {name}_)"""


def with_(*parts: str | list[str], then: str) -> str:
    flat = [x for p in parts for x in (p if isinstance(p, list) else [p])]
    return "WITH " + ",\n".join(flat) + "\n" + then
