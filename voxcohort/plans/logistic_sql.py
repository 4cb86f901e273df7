"""SQL counterparts of the grouped logistic models.

The fit is an accelerated descent in a recursive query, with a step per coordinate that
bounds the curvature; it shares nothing with the Newton fit but the loss.
"""

from __future__ import annotations

from voxcohort.functions import clinical as cl
from voxcohort.plans.registry import view

MOMENTUM, ROUNDS = 0.93, 700


def expression(feature: str) -> str:
    """A feature of the staged cohort as a double."""
    if feature.startswith("lat_"):
        return f"CASE WHEN laterality = '{feature[4:]}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"cast({feature} AS DOUBLE)"


def design_views(name: str, features: list[str], by: str | None = "fold", min_valid: int = 1, min_train: int = 1, source: str = "staged", label: str = "y") -> None:
    """<name>_x: (g, PatientID, y, train, x) with x = [1, standardised features], sets filled, scaled and guarded as in the plans."""
    n = range(len(features))
    cols = lambda f: ", ".join(f(k) for k in n)
    if by is None:      # one set that trains on all rows
        view(f"{name}_base", f"SELECT 'all' AS g, PatientID, {label} AS y, true AS train, {cols(lambda k: f'{expression(features[k])} AS f{k}')} FROM {source} s", (source,))
        min_valid = 0
    else:
        view(f"{name}_base", f"""SELECT cast(v.v AS VARCHAR) AS g, PatientID, {label} AS y, s.{by} IS DISTINCT FROM v.v AS train,
      {cols(lambda k: f'{expression(features[k])} AS f{k}')} FROM {source} s, (SELECT DISTINCT {by} AS v FROM {source} WHERE {by} IS NOT NULL) v""", (source,))
    view(f"{name}_good", f"SELECT g FROM {name}_base GROUP BY g HAVING count(*) FILTER (WHERE train) >= {min_train} AND count(*) FILTER (WHERE NOT train) >= {min_valid}", (f"{name}_base",))
    view(f"{name}_med", f"SELECT g, {cols(lambda k: f'coalesce(median(f{k}) FILTER (WHERE train), 0) AS m{k}')} FROM {name}_base JOIN {name}_good USING (g) GROUP BY g", (f"{name}_base", f"{name}_good"))
    view(f"{name}_fill", f"SELECT g, PatientID, y, train, {cols(lambda k: f'coalesce(f{k}, m{k}) AS f{k}')} FROM {name}_base JOIN {name}_med USING (g)", (f"{name}_base", f"{name}_med"))
    view(f"{name}_par", f"""SELECT g, {cols(lambda k: f'avg(f{k}) AS u{k}, stddev_pop(f{k}) AS s{k}')} FROM {name}_fill WHERE train GROUP BY g""", (f"{name}_fill",))
    z = cols(lambda k: f"(f{k} - u{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END")
    view(f"{name}_x", f"SELECT g, PatientID, y, train, [1.0::DOUBLE, {z}] AS x FROM {name}_fill JOIN {name}_par USING (g)", (f"{name}_fill", f"{name}_par"))


def fit_views(name: str, rows: str, p: int, classes: int, C: float = 0.5) -> None:
    """<name>_fit: (g, b) from <rows> (g, x, c, w) with class index c; b is a list of K lists of 1 + p coefficients (one list for two classes)."""
    k, q = (1 if classes == 2 else classes), p + 1
    zero = "[" + ", ".join(["0.0::DOUBLE"] * q) + "]"
    total = "list_sum([abs(v) FOR v IN x])"
    ridge = ["0.0", *[str(1.0 / C)] * p]
    bound = 0.25 if classes == 2 else 0.5
    view(f"{name}_step", f"SELECT g, [{', '.join(f'{bound} * sum(w * abs(x[{j + 1}]) * {total}) + {ridge[j]}' for j in range(q))}] AS d FROM {rows} GROUP BY g", (rows,))
    dots = ", ".join(f"list_dot_product(x, v{a}) AS h{a}" for a in range(k))
    top = "greatest(" + ", ".join(f"h{a}" for a in range(k)) + ")"
    gap = [f"1 / (1 + exp(-h0)) - (c = 1)::INT"] if k == 1 else [f"exp(h{a} - {top}) / ({' + '.join(f'exp(h{b} - {top})' for b in range(k))}) - (c = {a})::INT" for a in range(k)]
    sums = ", ".join(f"sum(w * r{a} * x[{j + 1}]) AS s{a}_{j}" for a in range(k) for j in range(q))
    kept = ", ".join(f"any_value(b{a}) AS b{a}, any_value(v{a}) AS v{a}" for a in range(k))
    new = lambda a: "[" + ", ".join(f"v{a}[{j + 1}] - (s{a}_{j} + {ridge[j]} * v{a}[{j + 1}]) / d[{j + 1}]" for j in range(q)) + "]"
    ahead = lambda a: "[" + ", ".join(f"n{a}[{j + 1}] + {MOMENTUM} * (n{a}[{j + 1}] - b{a}[{j + 1}])" for j in range(q)) + "]"
    view(f"{name}_walk", f"""SELECT g, 0 AS i, {', '.join(f'{zero} AS b{a}, {zero} AS v{a}' for a in range(k))} FROM {name}_step
      UNION ALL SELECT g, i + 1, {', '.join(f'n{a}, {ahead(a)}' for a in range(k))} FROM (
        SELECT *, {', '.join(f'{new(a)} AS n{a}' for a in range(k))} FROM (
          SELECT g, i, {kept}, {sums} FROM (
            SELECT *, {', '.join(f'{gap[a]} AS r{a}' for a in range(k))} FROM (
              SELECT t.g, t.i, r.x, r.c, r.w, {', '.join(f't.b{a}, t.v{a}' for a in range(k))}, {dots} FROM {name}_walk t JOIN {rows} r ON r.g = t.g WHERE t.i < {ROUNDS}))
          GROUP BY g, i) JOIN {name}_step USING (g))""", (f"{name}_step", rows))
    view(f"{name}_fit", f"SELECT g, [{', '.join(f'b{a}' for a in range(k))}] AS b FROM {name}_walk WHERE i = {ROUNDS}", (f"{name}_walk",))


def multinomial_views(name: str, features: list[str], classes: list[str], balanced: bool = True, **sets) -> None:
    """<name>_pred: (g, PatientID, y, p) of every row that does not train."""
    design_views(name, features, **sets)
    place = "CASE y " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(classes)) + " END"
    weight = "sum(count(*)) OVER (PARTITION BY g) / (count(*) OVER (PARTITION BY g) * count(*))" if balanced else "1.0"
    view(f"{name}_w", f"SELECT g, y, {weight} AS w FROM {name}_x WHERE train GROUP BY g, y", (f"{name}_x",))
    view(f"{name}_rows", f"SELECT g, x, {place} AS c, w FROM {name}_x JOIN {name}_w USING (g, y) WHERE train", (f"{name}_x", f"{name}_w"))
    fit_views(name, f"{name}_rows", len(features), len(classes))
    h = ", ".join(f"list_dot_product(x, b[{n + 1}])" for n in range(len(classes)))
    names = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    view(f"{name}_pred", f"SELECT g, PatientID, y, {names}[list_position(h, list_max(h))] AS p FROM (SELECT *, [{h}] AS h FROM {name}_x JOIN {name}_fit USING (g) WHERE NOT train)",
         (f"{name}_x", f"{name}_fit"))


def score_rows_view(out: str, name: str, features: list[str], classes: list[str], source: str, keys: str) -> None:
    """<out>: (keys, p) of other rows under the one model of ``multinomial_views(name, by=None)``."""
    n = range(len(features))
    z = ", ".join(f"(coalesce({expression(features[k])}, m{k}) - u{k}) / CASE WHEN s{k} > 0 THEN s{k} ELSE 1 END" for k in n)
    h = ", ".join(f"list_dot_product(x, b[{c + 1}])" for c in range(len(classes)))
    names = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    view(out, f"SELECT {keys}, {names}[list_position(h, list_max(h))] AS p FROM (SELECT *, [{h}] AS h FROM (SELECT *, [1.0::DOUBLE, {z}] AS x FROM {source}, {name}_med, {name}_par), {name}_fit)",
         (source, f"{name}_med", f"{name}_par", f"{name}_fit"))


def cox_newton_views(name: str, source: str, penalizer: float, steps: int = 8) -> None:
    """<name>_fit: (b1, b2) of a ridge Cox model on <source> (t, e, z1, z2): Newton steps written out one after another."""
    view(f"{name}_b0", "SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2")
    for k in range(steps):
        at = f"{name}_b{k}"
        view(f"{name}_w{k}", f"SELECT t, e, z1, z2, exp(b1 * z1 + b2 * z2) AS w FROM {source}, {at}", (source, at))
        view(f"{name}_t{k}", f"""SELECT t, d, ds, d1, d2, e1, e2, d11, d12, d22, {', '.join(f'sum({c}) OVER (ORDER BY t DESC) AS {c}' for c in ('s0', 's1', 's2', 's11', 's12', 's22'))} FROM (
          SELECT t, sum(e) AS d, sum(w * e) AS ds, sum(w * e * z1) AS d1, sum(w * e * z2) AS d2, sum(e * z1) AS e1, sum(e * z2) AS e2, sum(w * e * z1 * z1) AS d11, sum(w * e * z1 * z2) AS d12,
            sum(w * e * z2 * z2) AS d22, sum(w) AS s0, sum(w * z1) AS s1, sum(w * z2) AS s2, sum(w * z1 * z1) AS s11, sum(w * z1 * z2) AS s12, sum(w * z2 * z2) AS s22 FROM {name}_w{k} GROUP BY t)""", (f"{name}_w{k}",))
        view(f"{name}_m{k}", f"""SELECT *, (s1 - f * d1) / phi AS m1, (s2 - f * d2) / phi AS m2 FROM (SELECT *, l / d AS f, s0 - l / d * ds AS phi FROM (SELECT *, unnest(range(0, cast(d AS BIGINT))) AS l FROM {name}_t{k} WHERE d > 0))""", (f"{name}_t{k}",))
        view(f"{name}_n{k}", f"""SELECT b1, b2, e1 - m1 - p * b1 AS u1, e2 - m2 - p * b2 AS u2, i11 + p AS i11, i12, i22 + p AS i22 FROM {at},
          (SELECT sum(e1) AS e1, sum(e2) AS e2 FROM {name}_t{k} WHERE d > 0), (SELECT {penalizer} * count(*) AS p FROM {source}),
          (SELECT sum(m1) AS m1, sum(m2) AS m2, sum((s11 - f * d11) / phi - m1 * m1) AS i11, sum((s12 - f * d12) / phi - m1 * m2) AS i12, sum((s22 - f * d22) / phi - m2 * m2) AS i22 FROM {name}_m{k})""",
             (at, f"{name}_t{k}", f"{name}_m{k}", source))
        view(f"{name}_b{k + 1}", f"SELECT b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) AS b1, b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) AS b2 FROM {name}_n{k}", (f"{name}_n{k}",))
    view(f"{name}_fit", f"SELECT b1, b2 FROM {name}_b{steps}", (f"{name}_b{steps}",))


def ordinal_views(name: str, features: list[str], classes: list[str], **sets) -> None:
    """<name>_pred of the ordinal model: a binary fit per threshold."""
    design_views(name, features, **sets)
    place = "CASE y " + " ".join(f"WHEN '{c}' THEN {n}" for n, c in enumerate(classes)) + " END"
    top = len(classes)
    view(f"{name}_k", f"SELECT concat(g, '|', k) AS g, x, cast({place} >= k AS INT) AS c FROM {name}_x, range(1, {top}) t(k) WHERE train", (f"{name}_x",))
    view(f"{name}_rows", f"""SELECT k.g, x, c, CASE WHEN c = 1 THEN n / (2.0 * s) ELSE n / (2.0 * (n - s)) END AS w FROM {name}_k k
      JOIN (SELECT g, count(*) AS n, sum(c) AS s FROM {name}_k GROUP BY 1 HAVING s > 0 AND s < n) m ON m.g = k.g""", (f"{name}_k",))
    fit_views(name, f"{name}_rows", len(features), 2)
    view(f"{name}_ge", f"""SELECT x.g, PatientID, y, k, coalesce(1 / (1 + exp(-list_dot_product(x, b[1]))), 0) AS ge FROM {name}_x x, range(1, {top}) t(k)
      LEFT JOIN {name}_fit f ON f.g = concat(x.g, '|', k) WHERE NOT train""", (f"{name}_x", f"{name}_fit"))
    ge = ["1.0", *[f"max(ge) FILTER (WHERE k = {k})" for k in range(1, top)], "0.0"]
    share = "[" + ", ".join(f"greatest({ge[k]} - {ge[k + 1]}, 0)" for k in range(top)) + "]"
    names = "[" + ", ".join(f"'{c}'" for c in classes) + "]"
    view(f"{name}_pred", f"SELECT g, PatientID, y, {names}[list_position(s, list_max(s))] AS p FROM (SELECT g, PatientID, y, {share} AS s FROM {name}_ge GROUP BY g, PatientID, y)", (f"{name}_ge",))


def score_views(name: str) -> None:
    """<name>_by: balanced accuracy and rows per set."""
    view(f"{name}_by", f"SELECT g, avg(recall) AS balanced_accuracy, cast(sum(n) AS BIGINT) AS n FROM (SELECT g, y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM {name}_pred GROUP BY 1, 2) GROUP BY 1", (f"{name}_pred",))


LAT = [f"lat_{v}" for v in cl.LATERALITY_LEVELS]
