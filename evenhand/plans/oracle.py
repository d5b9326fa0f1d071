"""SQL building blocks for the oracle queries: draws, rounding and shared table expressions."""

from __future__ import annotations

from evenhand.plans.views import CLIENTS, LINE_FEATURES, MODELS, SEED, SWEEP, THETA


def dbl(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def rnd(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0::DOUBLE)"


def draw(salt: str, *keys: str, seed: int = SEED) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws(':', '{seed}', '{salt}', {parts}))"


def round_draw(salt: str, *keys: str, seed: int = SEED) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"substr(sha256(concat_ws(':', '{seed}', '{salt}', CAST(round // 4 AS VARCHAR), {parts})), 16 * (round % 4) + 1, 16)"


def word(h: str, slot: int = 0) -> str:
    return f"CAST(('0x' || substr({h}, {8 * slot + 1}, 8))::UBIGINT AS BIGINT)"


def unif(h: str, slot: int = 0) -> str:
    return f"(({word(h, slot)} + 1)::DOUBLE / 4294967297.0::DOUBLE)"


def gauss(h: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({unif(h, 0)})) * cos(2.0::DOUBLE * pi() * {unif(h, 1)}))"


def dot(theta, inputs) -> str:
    return "(" + " + ".join(f"{dbl(t)} * {v}" for t, v in zip(theta, inputs, strict=True)) + ")"


def ratio(numerator: str, denominator: str) -> str:
    return f"coalesce(CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0), 0.0::DOUBLE)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def cells(weight: str = "1", prefix: str = "n") -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN a = {a} AND y = {y} THEN {weight} ELSE 0 END) AS BIGINT) AS {prefix}_a{a}y{y}"
        for a in (0, 1)
        for y in (0, 1)
    )


def outcome_cells() -> str:
    return ", ".join(
        f"CAST(sum(CASE WHEN a = {a} AND y = {y} AND pred = {p} THEN 1 ELSE 0 END) AS BIGINT) AS c{a}{y}{p}"
        for a in (0, 1)
        for y in (0, 1)
        for p in (0, 1)
    )


_TP, _FP = "(c011 + c111)", "(c001 + c101)"
_TN, _FN = "(c000 + c100)", "(c010 + c110)"
_ALL = f"({_TP} + {_FP} + {_TN} + {_FN})"


def _f1() -> str:
    p, r = ratio(_TP, f"{_TP} + {_FP}"), ratio(_TP, f"{_TP} + {_FN}")
    return ratio(f"(2.0::DOUBLE * {p} * {r})", f"({p} + {r})")


def _gap(label: int) -> str:
    one, zero = (ratio(f"c{a}{label}1", f"c{a}{label}0 + c{a}{label}1") for a in (1, 0))
    return f"abs({one} - {zero})"


# Metric expressions over outcome_cells().
METRIC = {
    "n": _ALL,
    "accuracy": ratio(f"{_TP} + {_TN}", _ALL),
    "precision": ratio(_TP, f"{_TP} + {_FP}"),
    "recall": ratio(_TP, f"{_TP} + {_FN}"),
    "f1": _f1(),
    "tpr0": ratio("c011", "c010 + c011"),
    "tpr1": ratio("c111", "c110 + c111"),
    "eo_gap": _gap(1),
    "dp_gap": "abs(" + " - ".join(
        ratio(f"c{a}01 + c{a}11", f"c{a}00 + c{a}01 + c{a}10 + c{a}11") for a in (1, 0)
    ) + ")",
    "eod_gap": f"greatest({_gap(0)}, {_gap(1)})",
    "macro_f1": ratio(
        f"({ratio(f'2 * {_TP}', f'2 * {_TP} + {_FP} + {_FN}')} + {ratio(f'2 * {_TN}', f'2 * {_TN} + {_FP} + {_FN}')})",
        f"(CASE WHEN {_TP} + {_FP} + {_FN} > 0 THEN 1 ELSE 0 END + CASE WHEN {_TN} + {_FP} + {_FN} > 0 THEN 1 ELSE 0 END)",
    ),
    "balanced_accuracy": ratio(
        f"({ratio(_TP, f'{_TP} + {_FN}')} + {ratio(_TN, f'{_TN} + {_FP}')})",
        f"(CASE WHEN {_TP} + {_FN} > 0 THEN 1 ELSE 0 END + CASE WHEN {_TN} + {_FP} > 0 THEN 1 ELSE 0 END)",
    ),
}


def metrics(*names: str) -> str:
    return ", ".join((f"{big(METRIC[m])} AS n" if m == "n" else f"{rnd(METRIC[m])} AS {m}") for m in names)


def auc(source: str, by: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Expressions ``auc_*``: areas per ``by`` (a column list) from ``source(by, f, y)``, ties grouped."""
    return {
        f"{source}_steps": (
            (source,),
            f"SELECT {by}, f, sum(y) AS p, sum(1 - y) AS n FROM {source} GROUP BY {by}, f",
        ),
        f"{source}_cum": (
            (f"{source}_steps",),
            f"SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY f DESC) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY f DESC) AS fp, "
            f"sum(p) OVER (PARTITION BY {by}) AS all_p, sum(n) OVER (PARTITION BY {by}) AS all_n FROM {source}_steps",
        ),
        f"{source}_areas": (
            (f"{source}_cum",),
            f"SELECT {by}, CASE WHEN max(all_p) > 0 AND max(all_n) > 0 THEN sum(p * (all_n - fp + 0.5::DOUBLE * n)) / (max(all_p) * max(all_n))::DOUBLE "
            f"ELSE 0 END AS roc_auc, CASE WHEN max(all_p) > 0 AND max(all_n) > 0 THEN sum(p * tp::DOUBLE / (tp + fp)) / max(all_p)::DOUBLE ELSE 0 END AS pr_auc "
            f"FROM {source}_cum GROUP BY {by}",
        ),
    }


_LINE_INPUTS = [*LINE_FEATURES, "a"]
_STRATA = [(a, y) for a in (0, 1) for y in (0, 1)]


def _floored(source: str, floor: str, target: str, keep: str) -> str:
    """Quotas q_* with a floor of positives per group; (0, 0) absorbs what is left."""
    raised = ", ".join(
        f"CASE WHEN greatest({floor} - q_a{a}y1, 0) > 0 THEN greatest(0, q_a{a}y0 - greatest({floor} - q_a{a}y1, 0)) ELSE q_a{a}y0 END AS r{a}0, "
        f"q_a{a}y1 + greatest({floor} - q_a{a}y1, 0) AS r{a}1"
        for a in (0, 1)
    )
    return (
        f"SELECT {keep}, {big(f'greatest(0, r00 + {target} - (r00 + r01 + r10 + r11))')} AS q_a0y0, {big('r01')} AS q_a0y1, "
        f"{big('r10')} AS q_a1y0, {big('r11')} AS q_a1y1 FROM (SELECT *, {raised} FROM {source})"
    )


def _pick(prefix: str, a: str = "a", y: str = "y") -> str:
    return "CASE " + " ".join(f"WHEN {a} = {i} AND {y} = {j} THEN {prefix}_a{i}y{j}" for i, j in _STRATA) + " END"


def profile_body(source: str, by: str) -> str:
    pis = ", ".join(f"n_a{a}y{y}::DOUBLE / greatest(1, n) AS pi_a{a}y{y}" for a, y in _STRATA)
    return (
        f"SELECT *, {pis}, (n_a0y1 + n_a1y1)::DOUBLE / greatest(1, n) AS pi_plus FROM "
        f"(SELECT {by}, count(*) AS n, {cells()} FROM {source} GROUP BY {by})"
    )


def quota_body(profile: str, by: str, group_floor: int = 5) -> str:
    size = "CASE WHEN pi_plus > 0 THEN greatest(32, least(128, ceil(8.0::DOUBLE / nullif(pi_plus, 0)))) ELSE 32 END"
    rounded = ", ".join(f"{big(f'round_even(pi_a{a}y{y} * size, 0)')} AS q_a{a}y{y}" for a, y in _STRATA)
    inner = (
        f"(SELECT *, {rounded}, least({group_floor}, n_a0y1, n_a1y1) AS lift FROM "
        f"(SELECT *, {big(size)} AS size FROM {profile}))"
    )
    return _floored(inner, "lift", "size", f"{by}, size")


def batch_body(source: str, quotas: str, rounds: int) -> str:
    return (
        "SELECT * EXCLUDE (h, quota) FROM (SELECT *, row_number() OVER (PARTITION BY round, client_id, a, y ORDER BY h, row_id) AS pos "
        f"FROM (SELECT s.*, {_pick('q')} AS quota FROM (SELECT *, {round_draw('batch', 'row_id')} AS h FROM {source}, "
        f"(SELECT CAST(unnest(range({rounds})) AS INT) AS round)) s JOIN {quotas} USING (client_id))) WHERE pos <= quota"
    )


def _stats_body(batch: str) -> str:
    return (
        "SELECT *, q_a0y0 + q_a1y0 AS n0, q_a0y1 + q_a1y1 AS n1, greatest(0, (q_a0y0 + q_a1y0) - (q_a0y1 + q_a1y1)) AS delta FROM "
        f"(SELECT round, client_id, {cells(prefix='q')} FROM {batch} GROUP BY round, client_id)"
    )


def moment_body(batch: str, width: int) -> str:
    cell = (
        f"SELECT round, client_id, a, y, j, x[j + 1] AS v FROM {batch}, (SELECT CAST(unnest(range({width})) AS INT) AS j)"
    )
    return (
        "SELECT w.round, w.client_id, s.a, s.y, w.j, coalesce(p.m, w.m) AS mean, "
        "CASE WHEN (CASE WHEN p.n > 1 THEN p.sd ELSE w.sd END) > 1e-8 THEN (CASE WHEN p.n > 1 THEN p.sd ELSE w.sd END) ELSE 1.0::DOUBLE END AS std "
        f"FROM (SELECT round, client_id, j, avg(v) AS m, stddev_pop(v) AS sd FROM ({cell}) GROUP BY ALL) w "
        "CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(a, y) "
        f"LEFT JOIN (SELECT round, client_id, a, y, j, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM ({cell}) GROUP BY ALL) p "
        "ON w.round = p.round AND w.client_id = p.client_id AND s.a = p.a AND s.y = p.y AND w.j = p.j"
    )


def _syn_quota_body(stats: str) -> str:
    rounded = ", ".join(
        f"{big(f'round_even(q_a{a}y{y} * (least(32, n0 + n1)::DOUBLE / (n0 + n1)), 0)')} AS q_a{a}y{y}" for a, y in _STRATA
    )
    inner = f"(SELECT round, client_id, {big('least(32, n0 + n1)')} AS ds_target, {rounded} FROM {stats} WHERE n0 + n1 > 0)"
    return (
        "SELECT *, q_a0y0 + q_a0y1 + q_a1y0 + q_a1y1 AS ds_size, greatest(0, (q_a0y0 + q_a1y0) - (q_a0y1 + q_a1y1)) AS delta_s FROM ("
        + _floored(inner, "2", "ds_target", "round, client_id, ds_target")
        + ")"
    )


# Name -> (expressions it needs, body). Points are long: one row per feature j with value v.
EXPRESSIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        "SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), strftime(l_shipdate, '%Y-%m-%d')) AS row_id, "
        f"CAST(l_suppkey % {CLIENTS} AS INT) AS client_id, CAST(l_linestatus = 'F' AS INT) AS a, CAST(l_returnflag = 'R' AS INT) AS y, "
        f"{', '.join(LINE_FEATURES)}, [{', '.join(LINE_FEATURES)}] AS x, l_orderkey, l_linenumber, l_shipdate FROM lineitem",
    ),
    "scored": (("lines",), f"SELECT *, {dot(THETA, _LINE_INPUTS)} AS f FROM lines"),
    "predicted": (("scored",), "SELECT *, CAST(f > 0 AS INT) AS pred FROM scored"),
    "docs": (
        (),
        "SELECT CAST(doc_id AS VARCHAR) AS row_id, source AS client_id, CAST(toxic AS INT) AS a, CAST(1 - quality AS INT) AS y, "
        "[n_chars::DOUBLE, len(string_split(text, ' '))::DOUBLE] AS x FROM documents JOIN labels USING (doc_id)",
    ),
    "profile": (("lines",), profile_body("lines", "client_id")),
    "quotas": (("profile",), quota_body("profile", "client_id")),
    "batch": (("lines", "quotas"), batch_body("lines", "quotas", 2)),
    "stats": (("batch",), _stats_body("batch")),
    "moments": (("batch",), moment_body("batch", len(LINE_FEATURES))),
    "syn_quotas": (("stats",), _syn_quota_body("stats")),
    "syn": (
        ("syn_quotas", "moments"),
        f"SELECT round, client_id, 'synthetic' AS kind, pt_id, a, y, j, mean + 0.5::DOUBLE * std * {gauss(draw('syn', 'round', 'client_id', 'pt_id', 'j'))} AS v "
        f"FROM (SELECT *, concat_ws('-', 's', a, y, i) AS pt_id FROM (SELECT *, unnest(range(1, quota + 1)) AS i FROM "
        f"(SELECT m.*, {_pick('q')} AS quota FROM moments m JOIN syn_quotas USING (round, client_id))))",
    ),
    "slots": (
        ("syn_quotas", "stats"),
        "SELECT *, CAST(slot >= u_size // 2 AS INT) AS a FROM (SELECT *, unnest(range(u_size)) AS slot FROM "
        "(SELECT s.*, q.ds_size, q.delta_s, CAST(greatest(0, least(q.delta_s, q.ds_size, s.delta)) AS BIGINT) AS u_size "
        "FROM stats s JOIN syn_quotas q USING (round, client_id)))",
    ),
    "pool": (
        ("batch",),
        "SELECT round, client_id, y, a AS scope, x, row_number() OVER (PARTITION BY round, client_id, y, a ORDER BY pos) - 1 AS idx FROM batch "
        "UNION ALL SELECT round, client_id, y, 2 AS scope, x, row_number() OVER (PARTITION BY round, client_id, y ORDER BY pos, a) - 1 AS idx FROM batch",
    ),
    "picks": (
        ("slots",),
        "SELECT *, CASE WHEN ones > 0 THEN a ELSE 2 END AS pos_scope, CASE WHEN others > 0 THEN 1 - a ELSE 2 END AS neg_scope, "
        f"CASE WHEN ones > 0 THEN {word(draw('upos', 'round', 'client_id', 'slot'))} % ones WHEN n1 > 0 THEN {word(draw('upos', 'round', 'client_id', 'slot'))} % n1 END AS pos_idx, "
        f"CASE WHEN others > 0 THEN {word(draw('uneg', 'round', 'client_id', 'slot'))} % others WHEN n0 > 0 THEN {word(draw('uneg', 'round', 'client_id', 'slot'))} % n0 END AS neg_idx "
        "FROM (SELECT *, CASE a WHEN 1 THEN q_a1y1 ELSE q_a0y1 END AS ones, CASE a WHEN 1 THEN q_a0y0 ELSE q_a1y0 END AS others FROM slots)",
    ),
    "uni": (
        ("picks", "pool"),
        "SELECT p.round, p.client_id, 'universum' AS kind, 'u-' || slot AS pt_id, p.a, 1 AS y, j, "
        f"CASE WHEN u.x IS NOT NULL AND d.x IS NOT NULL THEN (u.x[j + 1] + d.x[j + 1]) / 2.0::DOUBLE ELSE 0.5::DOUBLE * {gauss(draw('unoise', 'p.round', 'p.client_id', 'slot', 'j'))} END AS v "
        f"FROM picks p CROSS JOIN (SELECT CAST(unnest(range({len(LINE_FEATURES)})) AS INT) AS j) "
        "LEFT JOIN pool u ON u.round = p.round AND u.client_id = p.client_id AND u.y = 1 AND u.scope = p.pos_scope AND u.idx = p.pos_idx "
        "LEFT JOIN pool d ON d.round = p.round AND d.client_id = p.client_id AND d.y = 0 AND d.scope = p.neg_scope AND d.idx = p.neg_idx",
    ),
    "payload": (
        ("syn", "uni"),
        "SELECT round, client_id, kind, pt_id, a, y, j, v FROM syn UNION ALL SELECT round, client_id, kind, pt_id, a, y, j, v FROM uni",
    ),
    # Payload points with their inputs in one row and the score of the fixed weights.
    "payload_scored": (
        ("payload", "syn_quotas"),
        f"SELECT round, client_id, kind, pt_id, a, y, delta_s, {dot(THETA, ['x[1]', 'x[2]', 'x[3]', 'x[4]', 'a'])} AS f FROM "
        "(SELECT round, client_id, kind, pt_id, a, y, list(v ORDER BY j) AS x FROM payload GROUP BY ALL) JOIN (SELECT round, client_id, delta_s FROM syn_quotas) USING (round, client_id)",
    ),
    "batch_scored": (
        ("batch",),
        f"SELECT round, client_id, a, y, {dot(THETA, ['x[1]', 'x[2]', 'x[3]', 'x[4]', 'a'])} AS f FROM batch",
    ),
    "sweep_rows": (
        ("lines",),
        "SELECT 'client' || client_id AS dataset, universum_off, rho, l_linenumber AS seed, CASE WHEN l_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS part, a, y, "
        f"CAST(({' + '.join(f't{i} * {v}' for i, v in enumerate(_LINE_INPUTS))}) > 0 AS INT) AS pred FROM lines, (VALUES "
        + ", ".join(f"({off}, {dbl(rho)}, {', '.join(dbl(t) for t in theta)})" for off, rho, theta in SWEEP)
        + ") c(universum_off, rho, t0, t1, t2, t3, t4)",
    ),
    "points": (
        ("sweep_rows",),
        f"SELECT dataset, universum_off, rho, seed, max(CASE WHEN part = 'val' THEN acc END) AS val_acc, max(CASE WHEN part = 'val' THEN eo END) AS val_eo, "
        "max(CASE WHEN part = 'test' THEN acc END) AS test_acc, max(CASE WHEN part = 'test' THEN eo END) AS test_eo FROM "
        f"(SELECT dataset, universum_off, rho, seed, part, {METRIC['accuracy']} AS acc, {METRIC['eo_gap']} AS eo FROM "
        f"(SELECT dataset, universum_off, rho, seed, part, {outcome_cells()} FROM sweep_rows GROUP BY ALL)) GROUP BY ALL",
    ),
    "grid": (
        ("points",),
        "SELECT dataset, universum_off, rho, "
        + ", ".join(f"round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std" for m in ("val_acc", "val_eo", "test_acc", "test_eo"))
        + ", count(*) AS n FROM points GROUP BY ALL",
    ),
    "model_rows": (
        ("lines",),
        f"SELECT 'client' || client_id AS dataset, model, l_linenumber AS seed, a, y, f, CAST(f > 0 AS INT) AS pred FROM (SELECT *, ({' + '.join(f't{i} * {v}' for i, v in enumerate(_LINE_INPUTS))}) AS f FROM lines, (VALUES "
        + ", ".join(f"('{m}', {', '.join(dbl(t) for t in theta)})" for m, theta in MODELS.items())
        + ") m(model, t0, t1, t2, t3, t4))",
    ),
    "model_metrics": (
        ("model_rows",),
        "SELECT dataset, model, seed, "
        + ", ".join(f"{METRIC[m]} AS {m}" for m in METRIC if m != "n")
        + f" FROM (SELECT dataset, model, seed, {outcome_cells()} FROM model_rows GROUP BY ALL)",
    ),
}
EXPRESSIONS.update(auc("model_rows", "dataset, model, seed"))


def query(select: str, *needs: str, **own: str) -> str:
    """``WITH`` the needed expressions, in order, and query-specific ones; then ``select``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in EXPRESSIONS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({EXPRESSIONS[n][1]})" for n in ordered] + [f"{n} AS ({body})" for n, body in own.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
