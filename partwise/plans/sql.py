"""Pieces of DuckDB text that the oracles share."""

from __future__ import annotations

from ..functions.expressions import POISSON, helmert
from ..operators.resample import FACTOR, STEP, WORD
from ..sources.orders import BASE_SQL, PARTS

N = len(PARTS)
ILR = [f"ilr_{i}" for i in range(1, N)]


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


def each(template: str, parts=PARTS, sep: str = ", ") -> str:
    """``template`` once per part, with ``{p}`` (the part)."""
    return sep.join(template.replace("{p}", p) for p in parts)


def uniform(*keys: str) -> str:
    text = " || '|' || ".join(f"cast({k} as varchar)" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0)"


def draws(*keys: str) -> str:
    u = uniform(*keys)
    return "(" + " + ".join(f"(case when {u} >= {p!r} then 1 else 0 end)" for p in POISSON) + ")"


def drawn(src: str, salt: str, reps: int, keys: str = "unit_id, label", key: str = "unit_id") -> str:
    """Rows ``keys, rep, x_, b_`` of every unit of ``src``: its 32-bit number in each replicate and its second word."""
    word = lambda k: f"('0x' || substr(md5('{salt}|' || cast({key} as varchar)), {1 + 8 * k}, 8))::bigint"
    mix = lambda inner, then="": f"(select * replace (xor(x_, x_ >> 16){then} as x_) from (select * replace ((xor(x_, x_ >> 16) * {FACTOR}) & {WORD} as x_) from (select * replace ((xor(x_, x_ >> 16) * {FACTOR}) & {WORD} as x_) from {inner})))"
    first = f"(select {keys}, rep, (a_ + rep * {STEP}) & {WORD} as x_, b_ from (select distinct {keys}, {word(0)} as a_, {word(1)} as b_ from {src}), (select unnest(range({reps})) as rep))"
    mixed = mix(first).replace("xor(x_, x_ >> 16) as x_", "xor(xor(x_, x_ >> 16), b_) as x_", 1)
    return mix(mixed)


def poisson(x: str = "x_") -> str:
    return "(" + " + ".join(f"(case when {x} / 4294967296.0 >= {p!r} then 1 else 0 end)" for p in POISSON) + ")"


def linear(weights, columns) -> str:
    return "(" + " + ".join(f"{w!r} * {c}" for w, c in zip(weights, columns, strict=True) if w) + ")"


def ilr_columns(parts=PARTS) -> str:
    return ", ".join(f"{linear(row, [f'ln({p})' for p in parts])} as ilr_{i}" for i, row in enumerate(helmert(len(parts)), 1))


def inverse_columns(coordinates, parts=PARTS) -> str:
    """Expressions ``e_p`` (exponents) of the inverse; close them with ``closed_columns('e_')``."""
    basis = helmert(len(parts))
    return ", ".join(f"exp({linear([row[k] for row in basis], coordinates)}) as e_{p}" for k, p in enumerate(parts))


def closed_columns(prefix: str = "", parts=PARTS, out: str = "") -> str:
    whole = "(" + " + ".join(f"{prefix}{p}" for p in parts) + ")"
    return ", ".join(f"{prefix}{p} / {whole} * 100 as {out}{p}" for p in parts)


def prep_ctes(src: str = "known", group: str = "label", x: str = "", zero_c: float = 0.5, parts=PARTS) -> str:
    """``{x}overall, {x}med, {x}fill, {x}delta, {x}closed, {x}z``: the preparation fitted on and applied to ``src``."""
    return f"""
{x}overall as materialized (select {each("quantile_cont({p}, 0.5) as g_{p}", parts)} from {src}),
{x}med as materialized (select {group} as grp, {each("quantile_cont({p}, 0.5) as m_{p}, count({p}) as n_{p}", parts)} from {src} group by {group}),
{x}fill as materialized (select s.* exclude ({", ".join(parts)}), {each("coalesce(s.{p}, case when n_{p} >= 5 then m_{p} else g_{p} end) as {p}, (s.{p} is null and n_{p} < 5) as fallback_{p}", parts)}
  from {src} s join {x}med on {group} = grp cross join {x}overall),
{x}delta as materialized (select {each(f"{zero_c!r} * min(case when {{p}} > 0 then {{p}} end) as d_{{p}}", parts)} from {x}fill),
{x}rep as materialized (select f.* exclude ({", ".join(parts)}), {each("case when f.{p} = 0 then d_{p} else f.{p} end as {p}", parts)} from {x}fill f cross join {x}delta),
{x}closed as materialized (select * exclude ({", ".join(parts)}), {closed_columns("", parts)} from {x}rep),
{x}z as materialized (select *, {each("ln({p}) - (" + each("ln({p})", parts, " + ") + f") / {len(parts)} as clr_{{p}}", parts)}, {ilr_columns(parts)} from {x}closed)"""


def grouped_ctes(src: str, keys: str, x: str = "", zero_c: float = 0.5, weight: str | None = None, parts=PARTS) -> str:
    """``{x}closed`` and ``{x}z``: each set of ``keys`` prepared by itself; ``weight`` counts copies of a row."""
    copies = f"(select s.* from {src} s, range({weight}) t(i))" if weight else src
    on = " and ".join(f"s.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return f"""
{x}med as materialized (select {keys}, {each("quantile_cont({p}, 0.5) as m_{p}", parts)} from {copies} group by {keys}),
{x}fill as materialized (select s.* exclude ({", ".join(parts)}), {each("coalesce(s.{p}, m_{p}) as {p}", parts)} from {src} s join {x}med q on {on}),
{x}delta as materialized (select {keys}, {each(f"{zero_c!r} * min(case when {{p}} > 0 then {{p}} end) as d_{{p}}", parts)} from {x}fill group by {keys}),
{x}rep as materialized (select s.* exclude ({", ".join(parts)}), {each("case when s.{p} = 0 then d_{p} else s.{p} end as {p}", parts)} from {x}fill s join {x}delta q on {on}),
{x}closed as materialized (select * exclude ({", ".join(parts)}), {closed_columns("", parts)} from {x}rep),
{x}z as materialized (select *, {ilr_columns(parts)} from {x}closed)"""


def query(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([BASE_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def long(table: str, keys: str, parts=PARTS, column: str = "{p}") -> str:
    """Rows ``keys, part, value`` of a wide table, nulls included."""
    return " union all ".join(f"select {keys + ', ' if keys else ''}'{p}' as part, cast({column.replace('{p}', p)} as double) as value from {table}" for p in parts)
