"""Registered queries: name -> (callable over the driver tables, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTERED: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        assert name not in REGISTERED, name
        REGISTERED[name] = (fn, oracle)
        return fn

    return add


def alert_sql(hits: str, detector: str, severity: str, sid: str, info: str, src: str, dst: str, packet: str = "packet_id") -> str:
    """Alert rows in DuckDB SQL from a relation ``hits`` with ts and packet_id."""
    return f"""
    SELECT ts, '{detector}' AS detector, sid, CASE WHEN contains(lower(info), 'critical') THEN 'CRITICAL'
           WHEN contains(lower(info), 'high') THEN 'HIGH' WHEN contains(lower(info), 'medium') THEN 'MEDIUM'
           WHEN contains(lower(info), 'low') THEN 'LOW' ELSE '{severity}' END AS threat,
           CASE WHEN contains(info, ' - ') THEN split_part(info, ' - ', 1) ELSE '{detector}' END AS type,
           src, dst, 'IP' AS proto, '[{detector}] ' || info AS rule, info, packet_id
    FROM (SELECT ts, CAST({sid} AS INT) AS sid, {src} AS src, {dst} AS dst, {info} AS info, {packet} AS packet_id
          FROM {hits} h) a"""


def cooldown_sql(hits: str, keys: list[str], seconds: float, strict: bool, order: str = "packet_id") -> str:
    """Greedy suppression in DuckDB SQL: the chain of each key, followed link by link."""
    part, op = ", ".join(keys), ">" if strict else ">="
    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
    gap = round(seconds * 1_000_000)
    return f"""(
    WITH RECURSIVE cand AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY ts, {order}) AS rn FROM {hits} h0),
    chain AS (
        SELECT * FROM cand WHERE rn = 1
        UNION ALL
        SELECT n.* FROM chain c, LATERAL (SELECT * FROM cand n WHERE {same} AND n.rn > c.rn
            AND epoch_us(n.ts) - epoch_us(c.ts) {op} {gap} ORDER BY n.rn LIMIT 1) n
    )
    SELECT * EXCLUDE (rn) FROM chain)"""
