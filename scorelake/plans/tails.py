"""SQL text of the tail probabilities, for the checks of the inference queries."""

from __future__ import annotations

import math
from itertools import count

from scorelake.functions import dist

_names = count()


def integral(low: str, high: str, f, steps: int = dist.STEPS) -> str:
    i = f"i{next(_names)}"
    width = f"((({high}) - ({low})) / {steps})"
    weight = f"CASE WHEN {i} = 0 OR {i} = {steps} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE + 2 * ({i} % 2) END"
    return f"(list_sum(list_transform(range({steps + 1}), lambda {i}: ({weight}) * {f(f'(({low}) + {width} * {i})')})) * {width} / 3)"


def _t_density(df: str):
    return lambda v: f"exp(ln(cosh({v})) - ({df} + 1) / 2 * ln(1 + pow(sinh({v}), 2) / {df}))"


def p_two_sided(t: str, df: str) -> str:
    t, df = f"({t})::DOUBLE", f"({df})::DOUBLE"
    start, end = f"asinh(abs({t}))", f"(3.5 + 40 / {df})"
    return f"({integral(start, f'greatest({end}, {start})', _t_density(df))} / {integral('0.0::DOUBLE', end, _t_density(df))})"


def p_less(t: str, df: str) -> str:
    return f"(CASE WHEN {t} > 0 THEN 1 - {p_two_sided(t, df)} / 2 ELSE {p_two_sided(t, df)} / 2 END)"


def p_f(f: str, d1: str, d2: str) -> str:
    f, d1, d2 = (f"({x})::DOUBLE" for x in (f, d1, d2))
    end = f"(80 * (1 / {d1} + 1 / {d2}) + 12 * sqrt(2 / {d1} + 2 / {d2}))"

    def density(w: str) -> str:
        return f"exp({w} * {d1} / 2 - ({d1} + {d2}) / 2 * ln((1 + {d1} * exp({w}) / {d2}) / (1 + {d1} / {d2})))"

    return f"({integral(f'least(greatest(ln({f}), -{end}), {end})', end, density)} / {integral(f'-{end}', end, density)})"


def normal_cdf(z: str) -> str:
    half = f"{integral('0.0::DOUBLE', f'least(abs({z}), 40.0)', lambda x: f'exp(-{x} * {x} / 2)', 400)} / {math.sqrt(2 * math.pi)!r}"
    return f"(0.5 + CASE WHEN {z} < 0 THEN -({half}) ELSE {half} END)"


def t_quantile(p: float, df: str) -> str:
    df = f"({df})::DOUBLE"
    whole = f"(2 * {integral('0.0::DOUBLE', f'(3.5 + 40 / {df})', _t_density(df))})"
    density = f"(exp(-({df} + 1) / 2 * ln(1 + x * x / {df})) / {whole})"
    rounds = f"list_transform(range({dist.ROUNDS}), lambda r: r::DOUBLE)"
    return f"list_reduce({rounds}, lambda x, y: x + ({p!r} - {p_less('x', df)}) / {density}, {dist.normal_quantile(p)!r}::DOUBLE)"


def _fast_normal_cdf(z: str) -> str:
    x = f"(abs({z}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + 0.5 * {x}))"
    power = repr(dist.ERFC[-1])
    for c in reversed(dist.ERFC[:-1]):
        power = f"({c!r} + {t} * {power})"
    tail = f"({t} * exp(-{x} * {x} + {power}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def p_studentized_range(q: str, k: str, df: str) -> str:
    q, k, df = (f"({x})::DOUBLE" for x in (q, k, df))
    spread = f"(8 / sqrt(2 * {df}))"
    low, high = f"greatest(1e-9, 1 - {spread})", f"(1 + {spread})"

    def scale(s: str) -> str:
        return f"exp(({df} - 1) * ln({s}) - {df} * ({s} * {s} - 1) / 2)"

    def below(width: str) -> str:
        def density(z: str) -> str:
            inside = f"greatest({_fast_normal_cdf(z)} - {_fast_normal_cdf(f'({z} - {width})')}, 0.0)"
            return f"(exp(-{z} * {z} / 2) * pow({inside}, {k} - 1))"

        return f"({k} * {integral('-8.0::DOUBLE', '8.0::DOUBLE', density, dist.RANGE_STEPS)} / {math.sqrt(2 * math.pi)!r})"

    part = f"({integral(low, high, lambda s: f'({scale(s)} * {below(f'({q} * {s})')})', dist.RANGE_STEPS)} / {integral(low, high, scale, dist.RANGE_STEPS)})"
    return f"greatest(0.0, least(1.0, 1 - {part}))"
