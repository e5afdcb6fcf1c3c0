"""SQL text of whole regressions for the twins: normal equations in lists, solved by elimination inside one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def matrix(size: int, width: int, cell: str) -> str:
    """A list of ``size`` rows of ``width`` numbers; ``cell`` reads the positions ``i`` and ``j``."""
    return f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {width + 1}), lambda j: {cell}))"


def eliminated(m: str, size: int, width: int) -> str:
    """Gauss-Jordan elimination of the first ``size`` columns. A column that earlier ones explain is skipped and its row zeroed."""
    pivots = ", ".join(f"[[{k}.0::DOUBLE]]" for k in range(1, size + 1))
    at = "CAST(b[1][1] AS BIGINT)"
    step = (
        f"CASE WHEN a[{at}][{at}] <= 1e-11 THEN CASE WHEN i = {at} OR j = {at} THEN 0.0 ELSE a[i][j] END"
        f" WHEN i = {at} THEN a[i][j] / a[{at}][{at}] ELSE a[i][j] - a[i][{at}] * a[{at}][j] / a[{at}][{at}] END"
    )
    return f"list_reduce([{m}, {pivots}], lambda a, b: {matrix(size, width, step)})"


def product(a: str, b: str, size: int) -> str:
    """Of two square matrices, the second one symmetric."""
    return matrix(size, size, f"list_dot_product({a}[i], {b}[j])")


def ols(
    name: str, source: str, y: str, terms: Mapping[str, str], weight: str = "1", keys: Sequence[str] = (), cluster: str | None = None,
    intercept: bool = True, lost: str = "0",
) -> str:
    """CTEs ending in ``name``: (keys, term, estimate, std_error, statistic, df, clusters) of a least-squares fit.

    ``terms`` maps names to expressions over ``source``. Columns are scaled and, with an intercept, taken less their means. ``lost`` counts
    degrees of freedom spent before, on absorbed factors.
    """
    n, k = name, len(terms)
    p = k + intercept
    by = "".join(f"{c}, " for c in keys)
    use = f" USING ({', '.join(keys)})" if keys else ""
    join = lambda left, right: f"{left} JOIN {right}{use}" if keys else f"{left}, {right}"
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in (*terms.values(), y))
    mean = (lambda i: f"avg(v[{i}])") if intercept else (lambda i: "0.0::DOUBLE")
    spread = lambda i: f"coalesce(nullif(sqrt(greatest(avg(v[{i}] * v[{i}]) - {f'avg(v[{i}]) * avg(v[{i}])' if intercept else '0'}, 0)), 0), 1)"
    scaled = [*(["1.0::DOUBLE"] if intercept else []), *(f"(v[{i}] - mu[{i}]) / sd[{i}]" for i in range(1, k + 2))]
    sums = ", ".join(f"sum(w * v[{i}] * v[{j}]) AS s{i}_{j}" for i in range(1, p + 2) for j in range(i, p + 2))
    entry = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    rows = ", ".join(
        "[" + ", ".join([*(entry(i, j) for j in range(1, p + 2)), *("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(1, p + 1))]) + "]" for i in range(1, p + 1)
    )
    gap = f"v[{p + 1}] - list_dot_product(beta, v[1:{p}])"
    if cluster:
        meat = f"""{n}_u AS (SELECT {by}c, [{", ".join(f"sum(w * ({gap}) * v[{i}])" for i in range(1, p + 1))}] AS u FROM {join(f"{n}_c", f"{n}_b")} GROUP BY {by}c),
    {n}_q AS (SELECT {by}CAST(count(*) AS DOUBLE) AS g, [{", ".join("[" + ", ".join(f"sum(u[{i}] * u[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1))}] AS meat
      FROM {n}_u{group}),
    {n}_h AS (SELECT {by}b.* EXCLUDE ({by.rstrip(', ') or 'inv'}){', inv' if not keys else ''}, g, {product('inv', 'meat', p)} AS half FROM {join(f"{n}_b b", f"{n}_q")}),
    {n}_v AS (SELECT *, g / (g - 1) * (n - 1) / df AS factor, {product('half', 'inv', p)} AS cov FROM {n}_h),"""
    else:
        meat = f"{n}_v AS (SELECT *, rss / df AS factor, inv AS cov, CAST(NULL AS DOUBLE) AS g FROM {n}_b),"
    back = [f"sd[{k + 1}] / sd[{i}]" for i in range(1, k + 1)]
    if intercept:
        # Row of the map from scaled to raw coefficients: the intercept gives up what the means carry.
        rows_back = ["[" + ", ".join([f"sd[{k + 1}]", *(f"-mu[{i}] * sd[{k + 1}] / sd[{i}]" for i in range(1, k + 1))]) + "]"]
        rows_back += ["[" + ", ".join(["0.0", *(back[i] if i == j else "0.0" for j in range(k))]) + "]" for i in range(k)]
        names, offset = ["(Intercept)", *terms], [f"mu[{k + 1}]", *["0.0"] * k]
    else:
        rows_back = ["[" + ", ".join(back[i] if i == j else "0.0" for j in range(k)) + "]" for i in range(k)]
        names, offset = list(terms), ["0.0"] * k
    return f"""{n}_r AS (SELECT {by}{cluster or '0'} AS c, CAST({weight} AS DOUBLE) AS w, [{listed}] AS v FROM {source}),
    {n}_o AS (SELECT * FROM {n}_r WHERE w <> 0 AND len(list_filter(v, lambda x: x IS NULL)) = 0{' AND c IS NOT NULL' if cluster else ''}),
    {n}_m AS (SELECT {by}CAST(count(*) AS DOUBLE) AS n, [{", ".join(map(mean, range(1, k + 2)))}] AS mu, [{", ".join(map(spread, range(1, k + 2)))}] AS sd FROM {n}_o{group}),
    {n}_c AS (SELECT {by}c, w, [{", ".join(scaled)}] AS v FROM {join(f"{n}_o", f"{n}_m")}),
    {n}_s AS (SELECT {by}{sums} FROM {n}_c{group}),
    {n}_e AS (SELECT {by}s{p + 1}_{p + 1} AS yy, [{", ".join(entry(i, p + 1) for i in range(1, p + 1))}] AS xy, {eliminated(f"[{rows}]", p, 2 * p + 1)} AS e FROM {n}_s),
    {n}_f AS (SELECT {by}yy, xy, {f"list_transform(range(1, {p + 1}), lambda i: e[i][{p + 1}])"} AS beta, {matrix(p, p, f"e[i][{p + 1} + j]")} AS raw,
      list_transform(range(1, {p + 1}), lambda i: e[i][i] <> 0) AS kept FROM {n}_e),
    {n}_b AS (SELECT {by}n, mu, sd, beta, kept, {matrix(p, p, "CASE WHEN kept[i] AND kept[j] THEN raw[i][j] ELSE 0.0 END")} AS inv, yy - list_dot_product(beta, xy) AS rss,
      n - len(list_filter(kept, lambda x: x)) - ({lost}) AS df FROM {join(f"{n}_f", f"{n}_m")}),
    {meat}
    {n}_t AS (SELECT *, [{", ".join(rows_back)}] AS back, unnest(range(1, {p + 1})) AS pos FROM {n}_v),
    {n} AS (SELECT {by}{list(names)!r}[pos] AS term, CASE WHEN kept[pos] THEN list_dot_product(back[pos], beta) + [{", ".join(offset)}][pos] END AS estimate,
      CASE WHEN kept[pos] THEN sqrt(factor * list_sum(list_transform(range(1, {p + 1}), lambda i: list_sum(list_transform(range(1, {p + 1}), lambda j: back[pos][i] * cov[i][j] * back[pos][j]))))) END AS std_error,
      estimate / std_error AS statistic, df, g AS clusters, n FROM {n}_t)"""


def t_inside(t: str, df: str) -> str:
    """Probability that a t variable with whole ``df`` lies within ``t`` of zero: the finite sums over powers of the cosine."""
    x, v = f"abs(CAST({t} AS DOUBLE))", f"CAST({df} AS DOUBLE)"
    cos2 = f"({v} / ({v} + {x} * {x}))"
    even = f"list_sum(list_transform(range(0, CAST({v} / 2 AS BIGINT)), lambda m: exp(lgamma(m + 0.5) - lgamma(m + 1.0) + m * ln({cos2})))) / sqrt(pi())"
    odd = f"coalesce(list_sum(list_transform(range(0, CAST(({v} - 1) / 2 AS BIGINT)), lambda m: exp(lgamma(m + 1.0) - lgamma(m + 1.5) + (m + 0.5) * ln({cos2})))), 0) * sqrt(pi()) / 2"
    sine = f"({x} / sqrt({v} + {x} * {x}))"
    return f"(CASE WHEN CAST({v} AS BIGINT) % 2 = 0 THEN {sine} * {even} ELSE 2 / pi() * (atan({x} / sqrt({v})) + {sine} * {odd}) END)"


def t_width(df: str) -> str:
    """97.5 % point of t with whole ``df``: the normal one's expansion, then a Newton step on the exact probability."""
    v, z = f"CAST({df} AS DOUBLE)", "1.959963984540054::DOUBLE"
    start = f"({z} + (pow({z}, 3) + {z}) / (4 * {v}) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * {v} * {v}) + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({v}, 3)))"
    density = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi()) * pow(1 + {start} * {start} / {v}, -({v} + 1) / 2)"
    return f"({start} - ({t_inside(start, df)} - 0.95::DOUBLE) / (2 * {density}))"


def normal_p(z: str) -> str:
    """Two-sided tail of the normal distribution, zero beyond 8."""
    x = f"(abs(CAST({z} AS DOUBLE)) / sqrt(2))"
    return f"(CASE WHEN {x} > 5.7 THEN 0.0 WHEN {x} = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda m: exp((2 * m + 1) * ln({x}) - lgamma(m + 1.5) - {x} * {x}))) END)"


def tested(name: str, normal: bool = False) -> str:
    """Columns p_value, conf_low and conf_high of a fit's CTE ``name``, unrounded."""
    if normal:
        width, p = "1.959963984540054::DOUBLE", normal_p("statistic")
    else:
        width, p = t_width("df"), f"1 - {t_inside('statistic', 'df')}"
    return f"{name}_p AS (SELECT *, {p} AS p_value, estimate - {width} * std_error AS conf_low, estimate + {width} * std_error AS conf_high FROM {name})"


def logit(name: str, source: str, y: str, terms: Mapping[str, str], keys: Sequence[str] = (), cluster: str | None = None, steps: int = 9) -> str:
    """CTEs ending in ``name``: (keys, term, estimate, std_error, statistic) after a fixed number of Newton steps from zero.

    Rows with equal regressors are counted first.
    """
    n, k = name, len(terms)
    p = k + 1
    by = "".join(f"{c}, " for c in keys)
    use = f" USING ({', '.join(keys)})" if keys else ""
    join = lambda left, right: f"{left} JOIN {right}{use}" if keys else f"{left}, {right}"
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in (*terms.values(), y))
    scaled = ["1.0::DOUBLE", *(f"(v[{i}] - mu[{i}]) / sd[{i}]" for i in range(1, k + 1))]
    out = [f"""{n}_r AS (SELECT {by}{cluster or '0'} AS c, [{listed}] AS v FROM {source}),
    {n}_o AS (SELECT * FROM {n}_r WHERE len(list_filter(v, lambda x: x IS NULL)) = 0{' AND c IS NOT NULL' if cluster else ''}),
    {n}_m AS (SELECT {by}CAST(count(*) AS DOUBLE) AS n, [{", ".join(f"avg(v[{i}])" for i in range(1, k + 1))}] AS mu,
      [{", ".join(f"coalesce(nullif(stddev_pop(v[{i}]), 0), 1)" for i in range(1, k + 1))}] AS sd FROM {n}_o{group}),
    {n}_c AS (SELECT {by}c, [{", ".join(scaled)}] AS v, CAST(count(*) AS DOUBLE) AS t, sum(v[{p}]) AS s FROM {join(f"{n}_o", f"{n}_m")} GROUP BY ALL),
    {n}_b0 AS (SELECT {by}[{", ".join(["0.0::DOUBLE"] * p)}] AS beta FROM {n}_m)"""]
    mu = "1 / (1 + exp(-list_dot_product(beta, v)))"
    entry = lambda i, j: f"h{min(i, j)}_{max(i, j)}"
    for step in range(steps + 1):
        hess = ", ".join(f"sum(t * mu * (1 - mu) * v[{i}] * v[{j}]) AS h{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1))
        grad = ", ".join(f"sum((s - t * mu) * v[{i}]) AS g{i}" for i in range(1, p + 1))
        rows = ", ".join(
            "[" + ", ".join([*(entry(i, j) for j in range(1, p + 1)), f"g{i}", *("1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(1, p + 1))]) + "]" for i in range(1, p + 1)
        )
        out.append(f"""{n}_x{step} AS (SELECT {by}c, v, t, s, beta, {mu} AS mu FROM {join(f"{n}_c", f"{n}_b{step}")}),
    {n}_s{step} AS (SELECT {by}any_value(beta) AS beta, {hess}, {grad} FROM {n}_x{step}{group}),
    {n}_e{step} AS (SELECT {by}beta, {eliminated(f"[{rows}]", p, 2 * p + 1)} AS e FROM {n}_s{step})""")
        if step < steps:
            out.append(f"{n}_b{step + 1} AS (SELECT {by}list_transform(range(1, {p + 1}), lambda i: beta[i] + e[i][{p + 1}]) AS beta FROM {n}_e{step})")
    out.append(f"""{n}_f AS (SELECT {by}beta, {matrix(p, p, f"e[i][{p + 1} + j]")} AS raw, list_transform(range(1, {p + 1}), lambda i: e[i][i] <> 0) AS kept FROM {n}_e{steps}),
    {n}_i AS (SELECT {by}n, mu, sd, beta, kept, {matrix(p, p, "CASE WHEN kept[i] AND kept[j] THEN raw[i][j] ELSE 0.0 END")} AS inv,
      n - len(list_filter(kept, lambda x: x)) AS df FROM {join(f"{n}_f", f"{n}_m")})""")
    if cluster:
        out.append(f"""{n}_u AS (SELECT {by}c, [{", ".join(f"sum((s - t * mu) * v[{i}])" for i in range(1, p + 1))}] AS u FROM {n}_x{steps} GROUP BY {by}c),
    {n}_q AS (SELECT {by}CAST(count(*) AS DOUBLE) AS g, [{", ".join("[" + ", ".join(f"sum(u[{i}] * u[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1))}] AS meat FROM {n}_u{group}),
    {n}_h AS (SELECT {by}n, mu, sd, beta, kept, inv, df, g, {product('inv', 'meat', p)} AS half FROM {join(f"{n}_i", f"{n}_q")}),
    {n}_v AS (SELECT *, g / (g - 1) * (n - 1) / df AS factor, {product('half', 'inv', p)} AS cov FROM {n}_h)""")
    else:
        out.append(f"{n}_v AS (SELECT *, 1.0::DOUBLE AS factor, inv AS cov FROM {n}_i)")
    back = ["[" + ", ".join(["1.0", *(f"-mu[{i}] / sd[{i}]" for i in range(1, k + 1))]) + "]"]
    back += ["[" + ", ".join(["0.0", *(f"1 / sd[{i + 1}]" if i == j else "0.0" for j in range(k))]) + "]" for i in range(k)]
    out.append(f"""{n}_t AS (SELECT *, [{", ".join(back)}] AS back, unnest(range(1, {p + 1})) AS pos FROM {n}_v),
    {n} AS (SELECT {by}{["(Intercept)", *terms]!r}[pos] AS term, CASE WHEN kept[pos] THEN list_dot_product(back[pos], beta) END AS estimate,
      CASE WHEN kept[pos] THEN sqrt(factor * list_sum(list_transform(range(1, {p + 1}), lambda i: list_sum(list_transform(range(1, {p + 1}), lambda j: back[pos][i] * cov[i][j] * back[pos][j]))))) END AS std_error,
      estimate / std_error AS statistic FROM {n}_t)""")
    return ",\n    ".join(out)
