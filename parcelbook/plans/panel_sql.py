"""SQL for fits with many columns: controls are swept out one after another.

The operators invert cross products; here every column is made orthogonal to the
controls before it, row by row, so the two ways share no formula but the model.
"""

from __future__ import annotations

from collections.abc import Sequence

YEARS = range(1995, 2002)


def swept(tag: str, source: str, keep: Sequence[str], controls: Sequence[str], values: Sequence[str]) -> str:
    """CTEs ``tag0``.. ; the last, ``tag``, has orthogonal controls and the values' residuals.

    A control that those before it explain (its square sum falls to rounding) is no control.
    """
    out, prev = [], source
    for i, c in enumerate(controls):
        later = [*controls[i + 1 :], *values]
        sums = ", ".join(f"sum({c} * {v}) AS p_{v}" for v in later)
        out.append(f"{tag}s{i} AS MATERIALIZED (SELECT sum({c} * {c}) AS p_0{', ' + sums if sums else ''} FROM {prev})")
        rest = ", ".join(f"{v} - {c} * CASE WHEN p_0 > 1e-14 THEN p_{v} / p_0 ELSE 0 END AS {v}" for v in later)
        columns = ", ".join([*keep, *controls[: i + 1]])
        out.append(f"{tag}{i} AS MATERIALIZED (SELECT {columns}, {rest} FROM {prev}, {tag}s{i})")
        prev = f"{tag}{i}"
    out.append(f"{tag} AS MATERIALIZED (SELECT * FROM {prev})")
    return ", ".join(out)


def marks(periods: dict[str, tuple[Sequence[int], int]], source: str) -> tuple[list[str], str]:
    """Names and columns of period dummies; the first ``skip`` periods of the sample have none."""
    names, columns = [], []
    for period, (values, skip) in periods.items():
        cut = f"(SELECT max({period}) FROM (SELECT DISTINCT {period} FROM {source} ORDER BY 1 LIMIT {skip}))"
        for v in values:
            names.append(f"{period}_{v}")
            columns.append(f"({period} = {v} AND {period} > {cut})::INT::DOUBLE AS {period}_{v}")
    return names, ", ".join(columns)


def within(tag: str, source: str, unit: str, keep: Sequence[str], columns: Sequence[str], periods: dict[str, tuple[Sequence[int], int]], trend: str = "") -> tuple[str, list[str]]:
    """CTEs that take unit means (and a unit's line) off columns and dummies; ``tag`` is the last."""
    names, dummies = marks(periods, source)
    every = [*columns, *names]
    if trend:
        line = lambda c: f"{c} - avg({c}) OVER w - coalesce(covar_pop({c}, {trend}) OVER w / nullif(var_pop({trend}) OVER w, 0), 0) * ({trend} - avg({trend}) OVER w) AS {c}"
    else:
        line = lambda c: f"{c} - avg({c}) OVER w AS {c}"
    ctes = f"{tag}r AS MATERIALIZED (SELECT *, {dummies} FROM {source}), {tag} AS MATERIALIZED (SELECT {', '.join([*keep, *map(line, every)])} FROM {tag}r WINDOW w AS (PARTITION BY {unit}))"
    return ctes, names


def fit(tag: str, source: str, y: str, regressors: Sequence[str], dummies: Sequence[str], shown: Sequence[str], extra: str = "0", spec: str = "") -> tuple[str, str]:
    """CTEs and a SELECT of the tidy coefficient table; ``source`` has cl, y, regressors and dummies.

    A shown term comes last in its own sweep, so its coefficient is that of the whole model.
    ``extra`` is the number of parameters that the transform took up.
    """
    ctes = [swept(f"{tag}d", source, ["cl"], dummies, [*regressors, y])]
    selects = []
    base = f"(SELECT count(*) AS n, count(DISTINCT cl) AS g, sum({y} * {y}) - sum({y}) * sum({y}) / count(*) AS sst FROM {source})"
    k = f"{len(regressors)} + {extra} + (SELECT {' + '.join(f'(sum(abs({d})) > 1e-9)::INT' for d in dummies) or '0'} FROM {source})"
    label = f", '{spec}' AS spec" if spec else ""
    for i, term in enumerate(shown):
        t = f"{tag}t{i}"
        ctes.append(swept(t, f"{tag}d", ["cl"], [r for r in regressors if r != term], [term, y]))
        ctes.append(f"{t}b AS MATERIALIZED (SELECT sum({term} * {y}) / sum({term} * {term}) AS b, sum({term} * {term}) AS xx FROM {t})")
        ctes.append(f"{t}c AS MATERIALIZED (SELECT sum({term} * ({y} - b * {term})) AS s, sum(({y} - b * {term}) * ({y} - b * {term})) AS e FROM {t}, {t}b GROUP BY cl)")
        ctes.append(
            f"{t}o AS MATERIALIZED (SELECT any_value(b) AS b, sqrt(sum(s * s) * any_value(g / (g - 1.0) * (n - 1.0) / (n - k))) / any_value(xx) AS se, any_value(n) AS n, any_value(k) AS k, any_value(g) AS g, 1 - sum(e) / any_value(sst) AS r2 FROM {t}c, {t}b, {base}, (SELECT {k} AS k))"
        )
        selects.append(
            f"SELECT '{term}' AS term, round(b, 6) AS b, round(se, 6) AS se, round(b / se, 6) AS t, round(b - 1.96 * se, 6) AS lo95, round(b + 1.96 * se, 6) AS hi95, CAST(n AS BIGINT) AS n, CAST(k AS INT) AS k, CAST(g AS BIGINT) AS clusters, round(r2, 6) AS r2{label} FROM {t}o"
        )
    return ", ".join(ctes), " UNION ALL ".join(selects)


def wild(tag: str, source: str, x: str, y: str, moved: str, controls: Sequence[str], grid: str, reps: int, seed: int, square: bool = False) -> str:
    """CTEs of wild cluster draws with the null imposed: ``tag`` has (candidate, rep, t).

    ``source`` has cl and the columns; the response of a candidate is y - candidate * moved.
    Signs are bits of md5 of seed, block of 128 draws and cluster.
    """
    plain = ", ".join(f"{c} AS {c}" for c in controls)
    ctes = [f"{tag}i AS MATERIALIZED (SELECT cl{', ' + plain if plain else ''}, {x} AS vx, {y} AS vy, {moved} AS vm FROM {source})"]
    ctes.append(swept(f"{tag}f", f"{tag}i", ["cl"], controls, ["vx", "vy", "vm"]))
    per = "".join(f", sum(vx * {c}) AS x_{c}, sum(vy * {c}) AS y_{c}, sum(vm * {c}) AS m_{c}" for c in controls)
    ctes.append(f"{tag}g AS MATERIALIZED (SELECT cl, sum(vx * vy) AS xy, sum(vx * vm) AS xm, sum(vx * vx) AS xx{per} FROM {tag}f GROUP BY cl)")
    squares = "".join(f", sum({c} * {c}) AS n_{c}" for c in controls)
    k = " + ".join(["1", *[f"(sum(abs({c})) > 1e-9)::INT" for c in controls]])
    ctes.append(f"{tag}n AS MATERIALIZED (SELECT sum(vx * vx) AS sxx, count(DISTINCT cl) / (count(DISTINCT cl) - 1.0) * (count(*) - 1.0) / (count(*) - ({k})) AS cc{squares} FROM {tag}f)")
    digit = "strpos('0123456789abcdef', substr(md5(concat({0}, ':', rep // 128, ':', cl)), CAST(1 + (rep % 128) // 4 AS INT), 1)) - 1".format(seed)
    ctes.append(f"{tag}v AS MATERIALIZED (SELECT cl, rep, CASE WHEN rep = 0 OR (({digit}) // CAST(power(2, 3 - rep % 4) AS INT)) % 2 = 1 THEN 1 ELSE -1 END AS v FROM (SELECT cl FROM {tag}g), (SELECT unnest(range({reps + 1})) AS rep))")
    moves = "".join(f", CASE WHEN max(n_{c}) > 1e-14 THEN sum(v * (y_{c} - candidate * m_{c})) / max(n_{c}) ELSE 0 END AS d_{c}" for c in controls)
    ctes.append(f"{tag}r AS MATERIALIZED (SELECT candidate, rep, sum(v * (xy - candidate * xm)) / max(sxx) AS b{moves} FROM {tag}g JOIN {tag}v USING (cl), {tag}n, ({grid}) GROUP BY 1, 2)")
    back = "".join(f" - x_{c} * d_{c}" for c in controls)
    ctes.append(f"{tag}q AS MATERIALIZED (SELECT candidate, rep, any_value(b) AS b, sqrt(any_value(cc) * sum(power(v * (xy - candidate * xm) - xx * b{back}, 2))) / any_value(sxx) AS se FROM {tag}g JOIN {tag}v USING (cl) JOIN {tag}r USING (rep), {tag}n GROUP BY 1, 2)")
    t = "CASE WHEN se > 1e-12 THEN b / se ELSE 0 END"
    ctes.append(f"{tag} AS MATERIALIZED (SELECT candidate, rep, {f'power({t}, 2)' if square else t} AS t FROM {tag}q)")
    return ", ".join(ctes)


def summary(tag: str, reps: int, seed: int, quantiles: dict[str, float] | None = None) -> str:
    """One row for each candidate: observed statistic, finite-replicate p and quantiles by index."""
    cuts = "".join(f", round(draws[{1 + min(reps - 1, int(q * reps))}], 6) AS {name}" for name, q in (quantiles or {}).items())
    return f"""SELECT candidate, round(observed, 6) AS observed, round((len(list_filter(draws, lambda t: abs(t) >= abs(observed) * (1 - 1e-9))) + 1) / {reps + 1}.0, 6) AS p{cuts}, CAST({reps} AS INT) AS reps, CAST({seed} AS INT) AS seed
      FROM (SELECT candidate, max(t) FILTER (WHERE rep = 0) AS observed, list_sort(list(t) FILTER (WHERE rep > 0)) AS draws FROM {tag} GROUP BY 1)"""
