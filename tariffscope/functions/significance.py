"""p-values as Spark SQL expressions.

Every function takes the names of columns of an *aggregated* frame (one row per
test), so nothing here touches data rows and no Python worker is started.
The p-values of Student's t and of Fisher's F are both a regularised incomplete
beta function, computed here with its continued fraction (modified Lentz).
The relative error grows with the degrees of freedom, to 3e-4 at 1e12.

The expressions are built as SQL text: they have many small parts, and text is
parsed in one step where each ``Column`` operation would be a call to the JVM.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 16  # lifts small arguments to where Stirling's series is exact enough
_STEPS = 600


def _let(name: str, body: str, **values: str) -> str:
    """``body`` with each value bound to ``name.<key>``, so none is repeated in the plan."""
    fields = ", ".join(f"'{key}', {value}" for key, value in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def _sum_over_shift(term: str) -> str:
    """Sum of ``term`` over i = 0 .. _SHIFT - 1."""
    return f"aggregate(sequence(0, {_SHIFT - 1}), 0D, (total, i) -> total + {term})"


def _stirling_tail(z: str) -> str:
    return f"((1/12D - (1/360D - 1/1260D/({z})/({z}))/({z})/({z}))/({z}))"


def _log_gamma(z: str) -> str:
    top = f"({z} + {_SHIFT})"
    return (
        f"(({top} - 0.5D)*ln({top}) - {top} + {0.5 * math.log(2 * math.pi)!r}D"
        f" + {_stirling_tail(top)} - {_sum_over_shift(f'ln({z} + i)')})"
    )


def _log_gamma_growth(a: str, b: str) -> str:
    """log(gamma(a + b) / gamma(a)), without subtracting two huge numbers."""
    top = f"({a} + {_SHIFT})"
    return (
        f"(({top} - 0.5D)*log1p({b}/{top}) + {b}*ln({top} + {b}) - {b}"
        f" + {_stirling_tail(f'{top} + {b}')} - {_stirling_tail(top)}"
        f" - {_sum_over_shift(f'log1p({b}/({a} + i))')})"
    )


def _log_beta(a: str, b: str) -> str:
    return _let(
        "g",
        f"{_log_gamma('g.small')} - {_log_gamma_growth('g.big', 'g.small')}",
        big=f"greatest({a}, {b})",
        small=f"least({a}, {b})",
    )


def _log(value: str, complement: str) -> str:
    """log(value), where complement = 1 - value is known exactly."""
    return f"if({complement} < 0.5D, log1p(-{complement}), ln({value}))"


def _away_from_zero(x: str) -> str:
    return f"if(abs({x}) < 1E-300D, 1E-300D, {x})"


def _beta_fraction(a: str, b: str, x: str) -> str:
    """1/(1 + d1/(1 + d2/(1 + ...))), the continued fraction of I_x(a, b)."""
    even = f"k.m*({b} - k.m)*{x}/(({a} + 2*k.m - 1)*({a} + 2*k.m))"
    odd = f"-({a} + k.m)*({a} + {b} + k.m)*{x}/(({a} + 2*k.m)*({a} + 2*k.m + 1))"
    next_state = _let(
        "e",
        "named_struct('c', e.c, 'd', e.d, 'h', s.h*e.c*e.d)",
        c=_away_from_zero("(1 + f.coefficient/s.c)"),
        d=f"1/{_away_from_zero('(1 + f.coefficient*s.d)')}",
    )
    with_coefficient = _let("f", next_state, coefficient=f"if(k.even, {even}, {odd})")
    step = _let("k", with_coefficient, m="cast(j div 2 as double)", even="j % 2 = 0")
    return (
        f"(1/aggregate(sequence(1, {_STEPS}), named_struct('c', 1D, 'd', 0D, 'h', 1D),"
        f" (s, j) -> {step}, s -> s.h))"
    )


def _regularized_beta(a: str, b: str, x: str, y: str) -> str:
    """I_x(a, b), where ``y`` is ``1 - x`` computed without cancellation."""
    front = f"v.a*{_log('v.x', 'v.y')} + v.b*{_log('v.y', 'v.x')} - {_log_beta('v.a', 'v.b')}"
    one_side = _let(
        "v",
        f"exp({front})/v.a*{_beta_fraction('v.a', 'v.b', 'v.x')}",
        a="if(u.lower, u.a, u.b)",
        b="if(u.lower, u.b, u.a)",
        x="if(u.lower, u.x, u.y)",
        y="if(u.lower, u.y, u.x)",
    )
    # The fraction converges fast below the mean; above it, use the mirror image.
    inside = _let("w", "if(u.lower, w.p, 1 - w.p)", p=one_side)
    return _let(
        "u",
        f"case when u.x <= 0 then 0D when u.y <= 0 then 1D else {inside} end",
        a=a, b=b, x=x, y=y, lower=f"{x} < ({a} + 1)/({a} + {b} + 2)",
    )


def t_two_sided(t: str, df: str) -> Column:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    n, square = f"cast({df} as double)", f"({t}*{t})"
    p = _regularized_beta(f"({n}/2)", "0.5D", f"({n}/({n} + {square}))", f"({square}/({n} + {square}))")
    return F.expr(f"case when {df} > 0 and {t} is not null then {p} end")


def f_upper(f: str, df1: str, df2: str) -> Column:
    """P(F >= f) for Fisher's F with ``df1`` and ``df2`` degrees of freedom."""
    n1, n2 = f"cast({df1} as double)", f"cast({df2} as double)"
    whole = f"({n2} + {n1}*{f})"
    p = _regularized_beta(f"({n2}/2)", f"({n1}/2)", f"({n2}/{whole})", f"({n1}*{f}/{whole})")
    return F.expr(f"case when {df1} > 0 and {df2} > 0 and {f} is not null then {p} end")
