"""SQL for small matrices: eigenvalues and rotations as recursive queries, for the twins of the factor operators.

A matrix of p rows is a list of p·p numbers, row by row.
"""


def correlation_sql(source: str, columns: list[str], name: str) -> str:
    """One row (m, n): the correlations of complete rows and their number."""
    cells = ", ".join(f"corr({a}, {b})" if a != b else "1.0" for a in columns for b in columns)
    return f"{name} AS (SELECT [{cells}]::DOUBLE[] AS m, count(*) AS n FROM {source})"


def eigen_sql(source: str, p: int, name: str, keys: tuple[str, ...] = (), sweeps: int = 12) -> str:
    """Rows (keys, k, value, vec) with k = 1 for the largest eigenvalue of m: cyclic Jacobi rotations, one a step."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    first, second = ([x[i] for x in pairs] for i in (0, 1))
    key = "".join(f"{k}, " for k in keys)
    cell = lambda m, r, c: f"{m}[({r}) * {p} + {c} + 1]"
    unit = ", ".join("1.0" if i == j else "0.0" for i in range(p) for j in range(p))
    turned = lambda m, at, along: (
        f"list_transform(range({p * p}), lambda x: CASE WHEN {at} = i THEN c * {cell(m, *along('i'))} - s * {cell(m, *along('j'))} "
        f"WHEN {at} = j THEN s * {cell(m, *along('i'))} + c * {cell(m, *along('j'))} ELSE {m}[x + 1] END)")
    rows = lambda m: turned(m, f"x // {p}", lambda r: (r, f"x % {p}"))
    columns = lambda m: turned(m, f"x % {p}", lambda r: (f"x // {p}", r))
    return f"""{name}_steps AS (
  SELECT {key}0 AS step, m, [{unit}]::DOUBLE[] AS v FROM {source}
  UNION ALL
  SELECT {key}step + 1, {columns("b")}, {columns("v")} FROM (
    SELECT *, {rows("m")} AS b FROM (
      SELECT *, cos(t) AS c, sin(t) AS s FROM (
        SELECT *, CASE WHEN {cell("m", "i", "j")} = 0 THEN 0 ELSE 0.5 * atan2(2 * {cell("m", "i", "j")}, {cell("m", "j", "j")} - {cell("m", "i", "i")}) END AS t FROM (
          SELECT *, {first}[step % {len(pairs)} + 1] AS i, {second}[step % {len(pairs)} + 1] AS j FROM {name}_steps WHERE step < {sweeps * len(pairs)}))))
), {name} AS (
  SELECT {key}row_number() OVER ({f"PARTITION BY {key[:-2]} " if keys else ""}ORDER BY {cell("m", "pick", "pick")} DESC) AS k, {cell("m", "pick", "pick")} AS value,
    list_transform(range({p}), lambda r: {cell("v", "r", "pick")}) AS vec
  FROM (SELECT *, unnest(range({p})) AS pick FROM {name}_steps WHERE step = {sweeps * len(pairs)})
)"""


def components_sql(eigen: str, p: int, factors: int, name: str, sweeps: int = 40) -> str:
    """Rows (f, loading, weight): varimax-rotated components, each with a positive sum of loadings, by explained variance.

    Two columns at a time are turned by the angle that maximises the criterion in their plane; rows are scaled to
    equal length while rotating, and the weights that make scores turn with the loadings.
    """
    pairs = [(i, j) for i in range(factors) for j in range(i + 1, factors)]
    first, second = ([x[i] for x in pairs] for i in (0, 1))
    size, steps = p * factors, sweeps * max(len(pairs), 1)
    at = lambda m, r, f: f"{m}[({r}) * {factors} + {f} + 1]"
    turn = lambda m: (
        f"list_transform(range({size}), lambda x: CASE WHEN x % {factors} = i THEN c * {at(m, f'x // {factors}', 'i')} + s * {at(m, f'x // {factors}', 'j')} "
        f"WHEN x % {factors} = j THEN c * {at(m, f'x // {factors}', 'j')} - s * {at(m, f'x // {factors}', 'i')} ELSE {m}[x + 1] END)")
    scaled = f"list_transform(range({p}), lambda r: {{col}} / len_[r + 1])"
    x, y = scaled.format(col=at("l", "r", "i")), scaled.format(col=at("l", "r", "j"))
    total = lambda e: f"list_sum(list_transform(range({p}), lambda r: {e}))"
    u, v = "(x_[r + 1] * x_[r + 1] - y_[r + 1] * y_[r + 1])", "(2 * x_[r + 1] * y_[r + 1])"
    return f"""{name}_kept AS (
  SELECT list(vec ORDER BY k) AS vecs, list(value ORDER BY k) AS vals FROM {eigen} WHERE k <= {factors}
), {name}_steps AS (
  SELECT 0 AS step, l, w, list_transform(range({p}), lambda r: sqrt(list_sum(list_transform(range({factors}), lambda f: {at("l", "r", "f")} ^ 2)))) AS len_ FROM (
    SELECT list_transform(range({size}), lambda x: vecs[x % {factors} + 1][x // {factors} + 1] * sqrt(vals[x % {factors} + 1])) AS l,
      list_transform(range({size}), lambda x: vecs[x % {factors} + 1][x // {factors} + 1] / sqrt(vals[x % {factors} + 1])) AS w FROM {name}_kept)
  UNION ALL
  SELECT step + 1, {turn("l")}, {turn("w")}, len_ FROM (SELECT *, cos(t) AS c, sin(t) AS s FROM (
    SELECT *, atan2(cross_ - 2 * a * b / {p}, diff - (a * a - b * b) / {p}) / 4 AS t FROM (
      SELECT *, {total(u)} AS a, {total(v)} AS b, {total(f"{u} ^ 2 - {v} ^ 2")} AS diff, 2 * {total(f"{u} * {v}")} AS cross_ FROM (
        SELECT *, {x} AS x_, {y} AS y_ FROM (
          SELECT *, {first}[step % {max(len(pairs), 1)} + 1] AS i, {second}[step % {max(len(pairs), 1)} + 1] AS j FROM {name}_steps WHERE step < {steps if pairs else 0})))))
), {name}_signed AS (
  SELECT list_transform(range({p}), lambda r: {at("l", "r", "g")}) AS loading, list_transform(range({p}), lambda r: {at("w", "r", "g")}) AS weight
  FROM (SELECT *, unnest(range({factors})) AS g FROM {name}_steps WHERE step = {steps if pairs else 0})
), {name} AS (
  SELECT row_number() OVER (ORDER BY list_sum(list_transform(loading, lambda x: x * x)) DESC) AS f,
    list_transform(loading, lambda x: x * sign_) AS loading, list_transform(weight, lambda x: x * sign_) AS weight
  FROM (SELECT *, CASE WHEN list_sum(loading) < 0 THEN -1 ELSE 1 END AS sign_ FROM {name}_signed)
)"""


def cholesky_distance_sql(source: str, columns: list[str], keep: str, name: str) -> str:
    """(keep, mahad): squared distances from the mean by the triangular factor of the covariances."""
    p = range(len(columns))
    stages, last = [f"{name}_c AS (SELECT {', '.join(f'avg({c}) AS mean{i}' for i, c in enumerate(columns))}, "
                    + ", ".join(f"covar_samp({columns[i]}, {columns[j]}) AS a{i}{j}" for i in p for j in p if j <= i) + f" FROM {source})"], f"{name}_c"
    for j in p:
        inner = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        stages.append(f"{name}_d{j} AS (SELECT *, sqrt(a{j}{j}{inner(j)}) AS l{j}{j} FROM {last})")
        stages.append(f"{name}_l{j} AS (SELECT *{''.join(f', (a{i}{j}{inner(i)}) / l{j}{j} AS l{i}{j}' for i in p if i > j)} FROM {name}_d{j})")
        last = f"{name}_l{j}"
    solved = f"(SELECT {keep}, {', '.join(f'{c} - mean{i} AS x{i}' for i, c in enumerate(columns))}, {last}.* FROM {source}, {last})"
    for i in p:
        solved = f"(SELECT *, (x{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i} AS y{i} FROM {solved})"
    return ", ".join(stages) + f", {name} AS (SELECT {keep}, {' + '.join(f'y{i} * y{i}' for i in p)} AS mahad FROM {solved})"


def least_squares_sql(source: str, unit: str, y: str, terms: list[str], name: str) -> str:
    """Rows (unit, term, n, estimate, std_error, t) of a fit per unit, by the eigenvectors of its normal equations.

    Columns are scaled to equal sums of squares first. Units without enough rows, or with dependent columns, have nulls.
    """
    columns, p = ["1.0", *terms], len(terms) + 1
    gram = ", ".join(f"sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b}))" for a in columns for b in columns)
    size = ", ".join(f"sqrt(sum({a} * {a}))" for a in columns)
    xy = ", ".join(f"sum({a} * {y}) / sqrt(sum({a} * {a}))" for a in columns)
    labels = ["(Intercept)", *terms]
    return f"""{name}_sums AS (
  SELECT {unit}, count(*) AS n, sum({y} * {y}) AS yy, [{gram}]::DOUBLE[] AS m, [{size}] AS size, [{xy}] AS xy FROM {source} GROUP BY {unit}
), {name}_whole AS (SELECT * FROM {name}_sums WHERE n > {p} AND len(list_filter(m, lambda x: x IS NULL OR isnan(x))) = 0),
{eigen_sql(f"{name}_whole", p, f"{name}_eigen", (unit,))},
{name}_spread AS (SELECT {unit}, min(value) AS least FROM {name}_eigen GROUP BY {unit}),
{name}_fit AS (
  SELECT {unit}, i, sum(vec[i + 1] * list_dot_product(vec, xy) / value) AS b, sum(vec[i + 1] ^ 2 / value) AS v
  FROM {name}_eigen JOIN {name}_whole USING ({unit}), (SELECT unnest(range({p})) AS i) GROUP BY {unit}, i
), {name}_left AS (
  SELECT {unit}, greatest(any_value(yy) - sum(b * xy[i + 1]), 0) / (any_value(n) - {p}) AS s2 FROM {name}_fit JOIN {name}_whole USING ({unit}) GROUP BY {unit}
), {name} AS (
  SELECT s.{unit}, {labels}[k.i + 1] AS term, s.n, CASE WHEN least > 1e-9 THEN b / size[k.i + 1] END AS estimate,
    CASE WHEN least > 1e-9 THEN sqrt(v * s2) / size[k.i + 1] END AS std_error, CASE WHEN least > 1e-9 AND v * s2 > 0 THEN b / sqrt(v * s2) END AS t
  FROM {name}_sums s CROSS JOIN (SELECT unnest(range({p})) AS i) k LEFT JOIN {name}_fit f ON f.{unit} = s.{unit} AND f.i = k.i
    LEFT JOIN {name}_left l ON l.{unit} = s.{unit} LEFT JOIN {name}_spread e ON e.{unit} = s.{unit}
)"""
