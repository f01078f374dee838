"""The SQL each query is checked against, on the base tables."""

from __future__ import annotations

from itertools import combinations

_CTES: dict[str, str] = {
    "transactions_all": """
SELECT o.o_custkey AS id, s.s_nationkey AS chain,
       CAST(floor((p.p_size - 1) / 10) AS INT) AS dept,
       p.p_type AS category, CAST(l.l_suppkey % 8 AS INT) AS company, p.p_brand AS brand,
       CAST(o.o_orderdate AS DATE) AS date,
       p.p_size AS productsize, l.l_linestatus AS productmeasure,
       CAST(l.l_quantity AS INT) AS purchasequantity,
       CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS purchaseamount,
       l.l_orderkey * 10000000 + l.l_linenumber * 1000000 + l.l_partkey AS txn_seq
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "offers": """
SELECT p_partkey AS offer, CASE WHEN p_type LIKE 'S%' THEN 'NEW ' || p_type ELSE p_type END AS category, 1 AS quantity,
       CAST(p_partkey % 6 AS INT) AS company, CAST(p_size / 25.0 AS DOUBLE) AS offervalue,
       CASE WHEN p_brand LIKE 'Brand#2_' THEN 'NEW ' || p_brand ELSE p_brand END AS brand
FROM part""",
    "history_base": """
SELECT c_custkey AS id, c_nationkey AS chain, c_custkey % (SELECT count(*) // 20 FROM part) * 19 AS offer, c_mktsegment AS market,
       DATE '2000-01-01' + CAST(c_custkey % 60 AS INT) AS offerdate
FROM customer""",
    "history": """
SELECT h.id, h.chain, h.offer, h.market, coalesce(r.n, 0) AS repeattrips,
       CASE WHEN coalesce(r.n, 0) > 0 THEN 't' ELSE 'f' END AS repeater, h.offerdate
FROM history_base h LEFT JOIN (
  SELECT b.id, count(DISTINCT t.date) AS n
  FROM history_base b JOIN offers f ON b.offer = f.offer
  JOIN transactions_all t ON t.id = b.id AND t.category = f.category
  WHERE t.date >= b.offerdate GROUP BY b.id) r ON r.id = h.id""",
    "history_train": "SELECT * FROM history WHERE id % 3 <> 0",
    "history_test": "SELECT id, chain, offer, market, offerdate FROM history_base WHERE id % 3 = 0",
    "transactions": """
SELECT t.* FROM transactions_all t JOIN history_base h ON t.id = h.id WHERE t.date < h.offerdate""",
    "reduced": "SELECT * FROM transactions WHERE category IN (SELECT category FROM offers)",
    "offered": """
SELECT h.*, f.category, f.company, f.brand, f.offervalue
FROM history_train h JOIN offers f ON h.offer = f.offer""",
}


def _r(expr: str, name: str, digits: int = 4) -> str:
    # Adding 0 turns -0.0 into 0.0.
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def _item(*columns: str) -> str:
    return " || '_' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


_CB = _item("category", "brand")
_CCB = _item("category", "company", "brand")
_FAMILY = _item("category", "brand", "company", "chain")
_SKU = _item("category", "brand", "company", "chain", "productsize", "productmeasure")


def _digits(text: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5(CAST({text} AS VARCHAR)), 1, 8)) AS UBIGINT) AS BIGINT)"


def _log_scale(x: str) -> str:
    return f"ln(1 + greatest(least(CAST({x} AS DOUBLE), 1e9), 0)) / ln(2)"


# ---- prices

_PRICED = f"""
SELECT *, {_SKU} AS item, {_FAMILY} AS family, CAST(purchaseamount AS DOUBLE) / purchasequantity AS price
FROM transactions WHERE purchasequantity > 1 AND purchaseamount > 0.01"""


def _trimmed(source: str, keys: str, value: str, per: int, out: str) -> str:
    return f"""
SELECT {keys}, avg({value}) AS {out} FROM (
  SELECT {keys}, {value}, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn,
         count(*) OVER (PARTITION BY {keys}) AS n FROM {source})
WHERE rn > n // {per} AND rn <= n - n // {per} GROUP BY {keys}"""


_ITEM_MEAN = {"priced": _PRICED, "item_mean": _trimmed("priced", "item", "price", 20, "m_item")}
_DISCOUNTS = {
    **_ITEM_MEAN,
    "own_mean": _trimmed("priced", "id, item, family", "price", 20, "m_own"),
    "discounts": """
SELECT o.id, o.item, o.family, m_own, m_item, m_item - m_own AS gap, 100.0 * (m_item - m_own) / m_item AS pct
FROM own_mean o JOIN item_mean m ON o.item = m.item""",
}

# ---- features

_MATCHED = """
SELECT t.*, h.offerdate AS offer_date, date_diff('day', t.date, h.offerdate) AS days,
       t.company = f.company AS m_company, t.category = f.category AS m_category,
       t.brand = f.brand AS m_brand, t.chain = h.chain AS m_chain
FROM transactions t JOIN history_base h ON t.id = h.id JOIN offers f ON h.offer = f.offer
WHERE t.date < h.offerdate"""


def _bought(name: str, match: str, windows: tuple[int, ...]) -> str:
    out = []
    for n in (None, *windows):
        hit = match if n is None else f"{match} AND days < {n}"
        s = "" if n is None else f"_{n}"
        out += [
            f"CAST(sum(CASE WHEN {hit} THEN 1 END) AS DOUBLE) AS has_bought_{name}{s}",
            f"CAST(sum(CASE WHEN {hit} THEN purchasequantity END) AS BIGINT) AS has_bought_{name}_q{s}",
            f"CAST(sum(CASE WHEN {hit} THEN purchaseamount END) AS DOUBLE) AS has_bought_{name}_a{s}",
        ]
    return ", ".join(out)


def _buy_history(windows: tuple[int, ...]) -> str:
    parts = ", ".join(_bought(k, f"m_{k}", windows) for k in ("company", "category", "brand"))
    return f"""
SELECT id, CAST(sum(purchaseamount) AS DOUBLE) AS total_spend,
       max(CASE WHEN m_chain THEN 1 END) AS has_bought_at_chain_before, {parts}
FROM matched GROUP BY id"""


_FIRSTS = """
SELECT id, dept, min(row(date, txn_seq)) AS first_match
FROM matched WHERE m_company AND m_category AND m_brand GROUP BY id, dept"""


def _buy_dept(windows: tuple[int, ...]) -> str:
    return f"""
SELECT m.id, {_bought('dept', 'TRUE', windows)}
FROM matched m JOIN firsts f ON m.id = f.id AND m.dept = f.dept
WHERE row(m.date, m.txn_seq) > f.first_match GROUP BY m.id"""


_CONTEXT = f"""
SELECT h.id, h.chain AS offer_chain, h.market AS offer_market, h.offerdate AS offer_date,
       f.category AS offer_category, f.company AS offer_company, f.brand AS offer_brand,
       f.offervalue AS offer_value, f.quantity AS offer_quantity,
       {_item('f.category', 'f.company', 'f.brand')} AS offer_item_id
FROM history_base h JOIN offers f ON h.offer = f.offer"""
_LABELS = """
SELECT id, CAST(CASE WHEN repeater = 't' THEN 1 ELSE 0 END AS DOUBLE) AS label FROM history_train
UNION ALL SELECT id, CAST(0.5 AS DOUBLE) FROM history_test"""
_NEVER = ", ".join(
    f"CASE WHEN has_bought_{k} IS NULL THEN 1 END AS never_bought_{k}" for k in ("company", "category", "brand", "dept"))
_CROSS = ", ".join(
    "CASE WHEN " + " AND ".join(f"has_bought_{k} IS NOT NULL" for k in c.split("_")) + f" THEN 1 END AS has_bought_{c}"
    for c in ("brand_company_category", "brand_category", "brand_company", "brand_dept", "company_dept"))
_SHORT = (30, 180)
_ALL = (30, 60, 90, 180)
_FEATURES = {
    "matched": _MATCHED,
    "firsts": _FIRSTS,
    "bought": _buy_history(_SHORT),
    "bought_dept": _buy_dept(_SHORT),
    "context": _CONTEXT,
    "labels": _LABELS,
    "feature_table": f"""
SELECT b.*, d.* EXCLUDE (id), {_NEVER}, {_CROSS}, c.* EXCLUDE (id), l.label
FROM bought b LEFT JOIN bought_dept d ON b.id = d.id JOIN context c ON b.id = c.id JOIN labels l ON b.id = l.id""",
}
_WINDOW = "date_diff('day', date, DATE '2000-02-01') > 0 AND date_diff('day', date, DATE '2000-02-01') < 180"


def _history_stats(prefix: str) -> str:
    return (f"count(*) AS {prefix}total, CAST(sum(purchaseamount) AS DOUBLE) AS {prefix}amount, "
            f"CAST(sum(purchasequantity) AS BIGINT) AS {prefix}quantity")


_ITEMS = {
    "items": f"SELECT {_CCB} AS item_id, category AS item_category, CAST(company AS VARCHAR) AS item_company, "
             f"brand AS item_brand, {_history_stats('item_')} FROM transactions WHERE {_WINDOW} "
             "GROUP BY category, company, brand",
    "categories": f"SELECT category AS category_id, {_history_stats('category_')} FROM transactions "
                  f"WHERE {_WINDOW} GROUP BY category",
    "items_categories": "SELECT * FROM items JOIN categories ON item_category = category_id",
    "ratios": """
SELECT *, CAST(item_total AS DOUBLE) / category_total AS item_popularity, item_amount / item_total AS item_avg_cost,
       category_amount / category_total AS category_avg_cost,
       (item_amount / item_total) / (category_amount / category_total) AS item_avg_cost_div_by_category_avg_cost
FROM items_categories""",
}
_PRICED_FEATURES = {
    **_FEATURES,
    **_ITEMS,
    "priced_features": "SELECT * FROM feature_table JOIN ratios ON offer_item_id = item_id",
}


def _windowed(prefix: str) -> list[str]:
    out = []
    for s in ("", "_30", "_180"):
        out += [(f"has_bought_{prefix}{s}", "d"), (f"has_bought_{prefix}_q{s}", "i"), (f"has_bought_{prefix}_a{s}", "d")]
    return out


_TEXT_FIELDS = [
    *[f for k in ("company", "category", "brand", "dept") for f in _windowed(k)],
    *[(f"never_bought_{k}", "i") for k in ("company", "category", "brand", "dept")],
    *[(f"has_bought_{c}", "i")
      for c in ("brand_company_category", "brand_category", "brand_company", "brand_dept", "company_dept")],
    ("total_spend", "d"), ("has_bought_at_chain_before", "i"),
    ("offer_chain", "i"), ("offer_market", "s"), ("offer_category", "s"), ("offer_company", "i"), ("offer_brand", "s"),
    ("offer_value", "d"), ("offer_quantity", "i"),
    ("item_category", "s"), ("item_company", "s"), ("item_brand", "s"),
    ("item_total", "i"), ("item_amount", "d"), ("item_quantity", "i"),
    ("category_id", "s"), ("category_total", "i"), ("category_amount", "d"), ("category_quantity", "i"),
    ("item_popularity", "d"), ("item_avg_cost", "d"), ("category_avg_cost", "d"),
    ("item_avg_cost_div_by_category_avg_cost", "d"),
]


def _field_text(name: str, kind: str) -> str:
    value = {"d": f"printf('%.6f', {name})", "i": f"CAST({name} AS VARCHAR)",
             "s": f"regexp_replace({name}, '[ :|]', '_', 'g')"}[kind]
    return f"CASE WHEN {name} IS NOT NULL THEN '{name}:' || {value} END"


_LINE = ("concat_ws(' ', CASE WHEN label = 0.5 THEN '0.5' ELSE CAST(CAST(label AS INT) AS VARCHAR) END || ' ''' || "
         "CAST(id AS VARCHAR) || ' |f', " + ", ".join(_field_text(*f) for f in sorted(_TEXT_FIELDS)) + ")")

# ---- item classifier

_NB = {
    "nb_counts": f"""
SELECT {_CCB} AS item, count(*) FILTER (WHERE repeater = 't') AS n_repeat,
       count(*) FILTER (WHERE repeater <> 't') AS n_norepeat FROM offered GROUP BY 1""",
    "nb_totals": "SELECT sum(n_repeat) AS r, sum(n_norepeat) AS nr, count(*) AS k FROM nb_counts",
}
_NB_P = ("1.0 / (1.0 + (CAST(coalesce(n_norepeat, 0) + 5 AS DOUBLE) / CAST(nr + 5 * k AS DOUBLE)) / "
         "(CAST(coalesce(n_repeat, 0) + 5 AS DOUBLE) / CAST(r + 5 * k AS DOUBLE)) * 3)")


def _nb_scored(rows: str) -> str:
    """p_repeat for rows that have category, company and brand."""
    return f"SELECT q.*, {_NB_P} AS p FROM ({rows}) q LEFT JOIN nb_counts c ON {_item('q.category', 'q.company', 'q.brand')} = c.item, nb_totals"


# ---- factors

_HALF = "(SELECT count(*) // 2 FROM embeddings)"
_DIM = 64
_ZEROS = "[x * CAST(0 AS DOUBLE) for x in range(" + str(_DIM) + ")]"
_FACTORS = {
    "vecs": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings",
    "mf": f"""
SELECT h.*, CASE WHEN u.f IS NULL OR v.f IS NULL THEN {_ZEROS} ELSE u.f END AS u,
       CASE WHEN u.f IS NULL OR v.f IS NULL THEN {_ZEROS} ELSE v.f END AS v, u.f IS NULL OR v.f IS NULL AS unknown
FROM history_base h JOIN offers o ON h.offer = o.offer
LEFT JOIN vecs u ON u.vec_id = 2 * (h.id % ({_HALF} + 10)) LEFT JOIN vecs v ON v.vec_id = 2 * (h.offer % ({_HALF} + 10)) + 1""",
}
_DOT = "(" + " + ".join(f"u[{i}] * v[{i}]" for i in range(1, _DIM + 1)) + ")"
_MF_TRAIN = f"""
SELECT h.id, h.repeattrips, h.repeater, {_DOT} AS score FROM history_train h JOIN mf USING (id)"""
_SCORED = {
    **_FACTORS,
    "scored": f"SELECT round(score + 1e-9, 6) AS score, CASE WHEN repeater = 't' THEN 1 ELSE 0 END AS actual "
              f"FROM ({_MF_TRAIN})",
}


def _roc(source: str) -> dict[str, str]:
    return {
        "points": f"SELECT score, sum(actual) AS pos, sum(1 - actual) AS neg FROM {source} GROUP BY score",
        "roc": """
SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST((SELECT sum(pos) FROM points) AS DOUBLE) AS p, CAST((SELECT sum(neg) FROM points) AS DOUBLE) AS n
FROM points WINDOW w AS (ORDER BY score DESC)""",
    }


_ROC_BODY = "SELECT score, tp, fp, " + ", ".join([
    _r("tp / p", "tpr"), _r("fp / n", "fpr"), _r("CAST(tp AS DOUBLE) / (tp + fp)", "precision"), _r("tp / p", "recall"),
    _r("2.0 * (CAST(tp AS DOUBLE) / (tp + fp)) * (tp / p) / nullif(CAST(tp AS DOUBLE) / (tp + fp) + tp / p, 0)", "f_score"),
]) + " FROM roc"

_PAIRS = {
    **_FACTORS,
    "pairs": f"SELECT DISTINCT 2 * (id % {_HALF}) AS u_id, 2 * ({_digits(_CCB)} % {_HALF}) + 1 AS v_id FROM transactions",
    "model": f"""
SELECT a.vec_id AS u_id, b.vec_id AS v_id, m FROM (
  SELECT x.vec_id, y.vec_id AS y_id, {_DOT.replace('u[', 'x.f[').replace('v[', 'y.f[')} AS m
  FROM vecs x, vecs y WHERE x.vec_id % 2 = 0 AND y.vec_id % 2 = 1) a(vec_id, y_id, m) JOIN vecs b ON b.vec_id = a.y_id""",
    "cells": """
SELECT m, CASE WHEN p.u_id IS NULL THEN 0 ELSE 1 END AS d
FROM model LEFT JOIN pairs p ON model.u_id = p.u_id AND model.v_id = p.v_id""",
}


def _means(thresholds: tuple[float, ...]) -> dict[str, str]:
    values = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in thresholds)
    return {
        **_PAIRS,
        "asked": f"SELECT * FROM (VALUES {values}) t(threshold)",
        "means": """
SELECT threshold, avg(d) AS mean_data, avg(m) AS mean_model, sqrt(avg((d - m) * (d - m))) AS rms,
       avg(CASE WHEN m > threshold THEN 1 ELSE 0 END) AS mean_sim,
       avg(CASE WHEN m > threshold THEN d ELSE 0 END) AS mean_cross FROM cells, asked GROUP BY threshold""",
        "rates": """
SELECT *, mean_cross AS tp, 1 - mean_data - mean_sim + mean_cross AS tn, mean_sim - mean_cross AS fp,
       mean_data - mean_cross AS fn FROM means""",
        "quality": """
SELECT *, mean_model / mean_data AS mean_ratio, tp / (tp + fp + 1e-11) AS precision, tp / (tp + fn + 1e-11) AS recall,
       fp / (fp + tn + 1e-11) AS fallout FROM rates""",
    }


_QUALITY = "SELECT " + ", ".join(
    _r(c, c, 6) for c in ("threshold", "mean_data", "mean_sim", "mean_cross", "mean_model", "mean_ratio", "rms",
                          "tp", "tn", "fp", "fn", "precision", "recall", "fallout")
) + ", " + _r("2 * precision * recall / nullif(precision + recall, 0)", "fscore", 6) + " FROM quality"

# ---- clusters

_CLUSTERS = {
    "clustered": f"""
SELECT h.*, e.label AS cluster FROM history_train h JOIN embeddings e ON e.vec_id = 2 * (h.id % {_HALF})""",
    "cluster_stats": """
SELECT cluster, count(*) AS num_train, count(*) FILTER (WHERE repeater = 't') AS num_train_repeat,
       CAST(count(*) FILTER (WHERE repeater = 't') + 10 AS DOUBLE) / (count(*) + CAST(10.0 AS DOUBLE) / CAST(0.3 AS DOUBLE)) AS frac
FROM clustered GROUP BY cluster""",
}

# ---- medians

_BINS = (("0-29 days", "days >= 0 AND days < 30"), ("30-59 days", "days >= 30 AND days < 60"),
         ("60-89 days", "days >= 60 AND days < 90"), ("90-179 days", "days >= 90 AND days < 180"),
         (">=180 days", "days >= 180"))


def _median_columns() -> tuple[str, str]:
    inner, outer = [], []
    subsets = [c for size in range(4) for c in combinations(("category", "company", "brand"), size)]
    for i, subset in enumerate(subsets):
        for name, cond in (("", "TRUE"), *_BINS):
            where = " AND ".join([cond, *[f"m_{k}" for k in subset]])
            tag = f"{i}" if not name else f"{name}_{i}"
            inner.append(f'nullif(count(*) FILTER (WHERE {where}), 0) AS "len_{tag}"')
            outer.append(f'"len_{tag}"')
            for short, column in (("ps", "productsize"), ("pq", "purchasequantity"), ("pa", "purchaseamount")):
                inner.append(
                    f'quantile_cont(CAST({column} AS DOUBLE), 0.5) FILTER (WHERE {where}) AS "{short}_median_{tag}"')
                outer.append(_r(f'"{short}_median_{tag}"', f'"{short}_median_{tag}"'))
    return ", ".join(inner), ", ".join(outer)


_MEDIAN_INNER, _MEDIAN_OUTER = _median_columns()

# ---- statistics

_CHI = ("offer", "chain", "market", "repeattrips", "offerdate", "category", "company", "offervalue", "brand")
_ENTROPY = ("chain", "company", "brand", "category", "repeattrips", "offervalue", "offerdate")
_DEPENDENT = ("category", "brand", "company", "repeater", "market", "offervalue", "chain", "item")


def _counts(features: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n, "
        f"count(*) FILTER (WHERE repeater = 't') AS pos FROM offered GROUP BY {c}" for c in features)


_EXPECTED = {
    "counts": _counts(_CHI),
    "expected": """
SELECT *, CAST(n AS DOUBLE) * (sum(pos) OVER w) / (sum(n) OVER w) AS e_pos,
       CAST(n AS DOUBLE) * (sum(n - pos) OVER w) / (sum(n) OVER w) AS e_neg
FROM counts WINDOW w AS (PARTITION BY feature)""",
}
_PAIR_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS val_a, CAST({b} AS VARCHAR) AS val_b, "
    f"count(*) AS n FROM with_item GROUP BY {a}, {b}" for a, b in combinations(_DEPENDENT, 2))

_LEVELS = ("offer", "chain", "market", "offerdate")


def _shrink_ctes() -> dict[str, str]:
    out = {"l0": "SELECT count(*) AS n, count(*) FILTER (WHERE repeater = 't') AS pos FROM history_train"}
    out["p0"] = "SELECT *, (pos + 10) / (n + CAST(10.0 AS DOUBLE) / CAST(0.3 AS DOUBLE)) AS p FROM l0"
    for d in range(1, 5):
        keys = ", ".join(_LEVELS[:d])
        on = " AND ".join(f"c.{k} = q.{k}" for k in _LEVELS[: d - 1]) or "TRUE"
        out[f"l{d}"] = (f"SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE repeater = 't') AS pos "
                        f"FROM history_train GROUP BY {keys}")
        out[f"p{d}"] = f"SELECT c.*, (c.pos + 10) / (c.n + CAST(10 AS DOUBLE) / q.p) AS p FROM l{d} c JOIN p{d - 1} q ON {on}"
    return out


def _shrink_body() -> str:
    parts = []
    for d in range(5):
        keys = ", ".join(k if i < d else f"NULL AS {k}" for i, k in enumerate(_LEVELS))
        parts.append(f"SELECT CAST({d} AS INT) AS depth, {keys}, n, pos, "
                     f"{_r('CAST(pos AS DOUBLE) / n', 'p_raw', 6)}, {_r('p', 'p', 6)} FROM p{d}")
    return " UNION ALL ".join(reversed(parts))


_SUMS = """
SELECT id, category, CAST(sum(productsize) AS DOUBLE) AS productsize, CAST(sum(purchasequantity) AS BIGINT) AS purchasequantity,
       CAST(sum(purchaseamount) AS DOUBLE) AS purchaseamount FROM transactions GROUP BY id, category"""
_BY_ITEM = f"""
SELECT id, {_CB} AS item, count(*) AS n_item_ids, CAST(sum(purchasequantity) AS BIGINT) AS n_purchases,
       CAST(sum(purchaseamount) AS DOUBLE) AS tot_amount, CAST(min(purchaseamount) AS DOUBLE) AS min_price,
       CAST(max(purchaseamount) AS DOUBLE) AS max_price FROM transactions GROUP BY 1, 2"""
_FRAMES = {
    "sums": _SUMS,
    "labels": _LABELS,
    "frame": """
SELECT h.id, h.chain, h.offer, h.market, f.category, f.company, f.brand, l.label, h.offerdate,
       CAST(coalesce(s.productsize, 0) AS DOUBLE) AS productsize, CAST(coalesce(s.purchasequantity, 0) AS DOUBLE) AS purchasequantity,
       CAST(coalesce(s.purchaseamount, 0) AS DOUBLE) AS purchaseamount, f.offervalue
FROM history_base h JOIN offers f ON h.offer = f.offer LEFT JOIN sums s ON s.id = h.id AND s.category = f.category
JOIN labels l ON l.id = h.id""",
}
_PAIR_COUNTS = {
    "ccb": "SELECT id, category, company, brand, count(*) AS n FROM transactions GROUP BY ALL",
    "pair_counts": f"""
SELECT CAST(dense_rank() OVER (ORDER BY id) AS INT) AS user_idx,
       CAST(dense_rank() OVER (ORDER BY category, company, brand) AS INT) AS item_idx, n, {_log_scale('n')} AS value
FROM ccb""",
}


def _minmax(c: str) -> str:
    return _r(f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)", c, 6)


# name -> (body, own CTEs)
_BODIES: dict[str, tuple[str, dict[str, str]]] = {}


def _q(name: str, body: str, ctes: dict[str, str] | None = None) -> None:
    _BODIES[name] = (body, ctes or {})


_q("src_catalog", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n_rows FROM {t}" for n, t in (
        ("transactions", "transactions"), ("offers", "offers"), ("history", "history_train"),
        ("history_test", "history_test"), ("reduced", "reduced"))))
_q("src_transactions", "SELECT * EXCLUDE (txn_seq, purchaseamount), CAST(purchaseamount AS DOUBLE) AS purchaseamount FROM transactions")
_q("src_offers", "SELECT offer, category, quantity, CAST(company AS BIGINT) AS company, offervalue, brand FROM offers")
_q("src_history_train", "SELECT id, chain, offer, market, CAST(repeattrips AS INT) AS repeattrips, repeater, offerdate FROM history_train")
_q("src_history_test", "SELECT * FROM history_test")

_q("sink_shard_by_customer", f"SELECT CAST({_digits('id')} % 100 AS INT) AS bucket, count(*) AS n_rows, "
   "count(DISTINCT id) AS n_customers FROM transactions GROUP BY 1")
_q("sink_sparse_text", f"SELECT {_LINE} AS line FROM priced_features", _PRICED_FEATURES)
_READ_BACK = {"d": "CAST(printf('%.6f', {0}) AS DOUBLE)", "i": "{0}", "s": "regexp_replace({0}, '[ :|]', '_', 'g')"}
_q("src_sparse_lines", "SELECT id, CAST(label AS DOUBLE) AS label, "
   + ", ".join(f"{_READ_BACK[k].format(n)} AS {n}" for n, k in _TEXT_FIELDS) + " FROM priced_features", _PRICED_FEATURES)
_q("sink_routed", """
SELECT CASE WHEN label = 0.5 THEN 'test' WHEN offer_date < DATE '2000-02-01' THEN 'train_early' ELSE 'train_late' END AS split,
       count(*) AS n_rows FROM feature_table GROUP BY 1""", _FEATURES)
_q("sink_items_categories", """
SELECT 'item' AS kind, item_id AS id, item_total AS total, item_amount AS amount, item_quantity AS quantity,
       item_category AS category, item_company AS company, item_brand AS brand FROM items
UNION ALL SELECT 'category', category_id, category_total, category_amount, category_quantity, NULL, NULL, NULL FROM categories""",
   _ITEMS)
_q("sink_submission", f"SELECT id, {_r('p', 'repeatProbability', 6)} FROM ("
   + _nb_scored("SELECT h.id, f.category, f.company, f.brand FROM history_test h JOIN offers f ON h.offer = f.offer") + ")", _NB)
_q("sink_labels", "SELECT id, label FROM priced_features", _PRICED_FEATURES)

_q("item_cat_brand", f"SELECT offer, {_CB} AS item FROM offers")
_q("item_ccb", f"SELECT offer, {_CCB} AS item FROM offers")
_q("id_item", f"SELECT txn_seq, {_item('id')} || '_' || {_CB} AS id_item FROM transactions")
_q("item_family", f"SELECT txn_seq, {_FAMILY} AS item_family, {_item('id')} || '_' || {_FAMILY} AS id_item_family FROM transactions")
_q("item_sku", f"SELECT txn_seq, {_SKU} AS item, {_item('id')} || '_' || {_SKU} AS id_item FROM transactions")
_q("hash_sample", f"SELECT id, txn_seq FROM transactions WHERE {_digits('id')} / 4294967296.0 < 0.25")
_q("id_mod_sample", "SELECT id, txn_seq FROM transactions WHERE id % 10 = 2")
_q("id_mod_group", "SELECT id, id % 100 AS group_no FROM history_train")
_q("price_filter", "SELECT txn_seq, purchasequantity, CAST(purchaseamount AS DOUBLE) AS purchaseamount FROM transactions "
   "WHERE purchasequantity > 1 AND purchaseamount > 0.01")
_q("unit_price", f"SELECT txn_seq, {_r('CAST(purchaseamount AS DOUBLE) / purchasequantity', 'price', 6)} FROM transactions")
_q("value_cutoff", f"SELECT user_idx, item_idx, n, {_r('value', 'value', 6)} FROM pair_counts WHERE value > 1.5", _PAIR_COUNTS)
_q("log_scale", f"SELECT id, {_r(_log_scale('count(*)'), 'scaled', 6)} FROM transactions GROUP BY id")
_q("log_scale_capped", f"SELECT id, category, {_r('log2(1 + least(count(*), 7))', 'scaled', 6)} FROM transactions GROUP BY id, category")
_q("diff_days", "SELECT txn_seq, CAST(days AS INT) AS before_offer, CAST(-days AS INT) AS after_offer FROM matched", {"matched": _MATCHED})
_days = "date_diff('day', date, DATE '2014-01-01') / 30.0"
_q("diff_months", f"SELECT txn_seq, {_r(_days, 'months', 6)} FROM transactions")
_q("valid_date", """
SELECT count(*) FILTER (WHERE length(d) = 10 AND try_cast(d AS DATE) IS NOT NULL) AS n_valid,
       count(DISTINCT CASE WHEN length(d) <> 10 OR try_cast(d AS DATE) IS NULL THEN d END) AS n_bad_dates
FROM (SELECT CAST(date AS VARCHAR) AS d FROM transactions)""")
_q("recency_bins", "SELECT id, txn_seq, " + ", ".join(
    f'CASE WHEN {cond} THEN 1 ELSE 0 END AS "{name}"' for name, cond in _BINS) + " FROM matched", {"matched": _MATCHED})
_q("repeater_flag", "SELECT id, repeattrips > 0 AS is_repeater FROM history_train")
_q("label_encode", _LABELS)
_q("cap_repeats", "SELECT id, least(repeattrips, 5) AS repeat_trips FROM history_train")
_q("early_late_split", "SELECT id, CASE WHEN offerdate < DATE '2000-02-01' THEN 'early' ELSE 'late' END AS part FROM history_train")
_q("clean_numeric", f"""
SELECT h.id, {_r('coalesce(productsize, 0)', 'productsize')},
       {_r('coalesce(purchaseamount / nullif(purchasequantity, 0), 0)', 'per_unit')}
FROM offered h LEFT JOIN sums s ON s.id = h.id AND s.category = h.category""", {"sums": _SUMS})
_q("drop_reorder", "SELECT id, chain, offer, market, repeater, category, company, brand, offervalue FROM offered")
_q("score_clamp", f"SELECT id, {_r(f'least(greatest({_DOT}, 1e-8), 10.0)', 'score', 6)} FROM mf", _FACTORS)
_q("format_fixed", "SELECT offer, printf('%.6f', offervalue) AS value_text FROM offers")

_q("join_history_offers", "SELECT * EXCLUDE (repeattrips) FROM offered")
_q("join_history_offers_outer", """
SELECT h.*, f.category, f.quantity, f.company, f.offervalue, f.brand
FROM history_train h LEFT JOIN offers f ON h.offer = f.offer""")
_q("reduce_category", "SELECT id, txn_seq, category FROM reduced")
_q("reduce_cat_or_company", """
SELECT id, txn_seq, category, company FROM transactions
WHERE category IN (SELECT category FROM offers) OR company IN (SELECT company FROM offers)""")
_q("reduce_any", """
SELECT id, txn_seq, category, company, brand FROM transactions
WHERE category IN (SELECT category FROM offers) OR company IN (SELECT company FROM offers)
   OR brand IN (SELECT brand FROM offers)""")
_q("join_txn_offer", """
SELECT t.id, t.txn_seq, t.date, f.offer, h.offerdate AS offer_date, h.chain AS offer_chain, h.market AS offer_market,
       f.category AS offer_category, f.company AS offer_company, f.brand AS offer_brand, f.offervalue AS offer_value
FROM transactions t JOIN history_base h ON t.id = h.id JOIN offers f ON h.offer = f.offer WHERE t.date < h.offerdate""")
_q("left_join_aggs", """
SELECT h.id, h.category, s.productsize, s.purchasequantity, s.purchaseamount
FROM offered h LEFT JOIN sums s ON s.id = h.id AND s.category = h.category""", {"sums": _SUMS})
_q("join_item_category_stats", "SELECT * FROM items_categories", _ITEMS)
_q("join_features_item_stats", f"""
SELECT id, label, total_spend, offer_item_id, item_total, category_total, {_r('item_popularity', 'item_popularity', 6)}
FROM priced_features""", _PRICED_FEATURES)
_q("join_scores_default", f"SELECT t.id, {_r('coalesce(p, 0)', 'repeatProbability', 6)} FROM history_test t LEFT JOIN ("
   + _nb_scored("SELECT h.id, f.category, f.company, f.brand FROM history_test h JOIN offers f ON h.offer = f.offer "
                "WHERE h.id IN (SELECT id FROM reduced)") + ") s ON s.id = t.id", _NB)
_q("anti_missing_ids", """
SELECT id, 'test_without_transactions' AS kind FROM history_test WHERE id NOT IN (SELECT id FROM reduced)
UNION ALL SELECT DISTINCT id, 'transactions_without_offer' FROM transactions WHERE id NOT IN (SELECT id FROM history_train)""")
_q("cluster_lookup", f"""
SELECT c.id, c.cluster, s.num_train, s.num_train_repeat, {_r('s.frac', 'frac_repeater', 6)}
FROM clustered c JOIN cluster_stats s ON c.cluster = s.cluster""", _CLUSTERS)

for _k in ("dept", "category", "company", "brand"):
    _q(f"cnt_id_{_k}", f"SELECT id, {_k}, count(*) AS sum_{_k} FROM transactions GROUP BY id, {_k}")
_q("cnt_id_ccb", "SELECT id, category, company, brand, count(*) AS count_trans FROM transactions GROUP BY ALL")
_q("sink_csv", _BODIES["cnt_id_ccb"][0])
_q("cnt_id_cc", "SELECT id, category, company, count(*) AS count_trans FROM transactions GROUP BY ALL")
_q("cnt_not_this_brand", """
SELECT b.id, b.category, b.company, b.brand, b.n AS count_trans, c.n - b.n AS count_not_this_brand
FROM (SELECT id, category, company, brand, count(*) AS n FROM transactions GROUP BY ALL) b
JOIN (SELECT id, category, company, count(*) AS n FROM transactions GROUP BY ALL) c USING (id, category, company)""")
_q("sum_qty_ccb", "SELECT id, category, company, brand, CAST(sum(purchasequantity) AS BIGINT) AS sum_pq FROM transactions GROUP BY ALL")
_q("basket_size", f"SELECT id, chain, {_r('CAST(count(*) AS DOUBLE) / (count(DISTINCT date) + 1)', 'avg_basket_size')}, "
   "count(DISTINCT date) AS visits FROM transactions GROUP BY id, chain")
_months = "date_diff('day', min(date), max(date)) / CAST(30 AS DOUBLE)"
_q("monthly_spend", f"SELECT id, chain, {_r(f'CAST(sum(purchaseamount) AS DOUBLE) / ({_months} + 1)', 'monthly_avg_pa')}, "
   f"{_r(_months, 'max_min_months')} FROM transactions GROUP BY id, chain")
_q("sums_id_category", _SUMS)
_q("med_groups", f"SELECT h.id, {_MEDIAN_OUTER} FROM history_base h LEFT JOIN medians m ON m.id = h.id",
   {"matched": _MATCHED, "medians": f"SELECT id, {_MEDIAN_INNER} FROM matched GROUP BY id"})
_q("cust_count", "SELECT id, count(*) AS n FROM transactions GROUP BY id")
_q("agg_id_item", _BY_ITEM)
_q("agg_rollup_id", f"""
SELECT id, count(*) AS n_unique, CAST(sum(n_purchases) AS BIGINT) AS n_purchases_all, {_r('sum(tot_amount)', 'tot_amount_all')},
       min(min_price) AS min_price_all, max(max_price) AS max_price_all FROM by_item GROUP BY id""", {"by_item": _BY_ITEM})
_q("diversity_item", f"""
SELECT o.id, o.item, b.n_purchases, {_r('CAST(n_purchases + 30 AS DOUBLE) / (n_purchases + 300)', 'diversity', 6)}
FROM (SELECT id, {_CB} AS item FROM offered) o LEFT JOIN by_item b ON b.id = o.id AND b.item = o.item""", {"by_item": _BY_ITEM})
_q("agg_id_diversity", f"""
SELECT id, CAST(sum(purchasequantity) AS BIGINT) AS n_tot_by_id, CAST(sum(purchaseamount) AS DOUBLE) AS spend_tot_by_id,
       count(DISTINCT item) AS n_unique_by_id,
       {_r('CAST(count(DISTINCT item) + 10 AS DOUBLE) / (sum(purchasequantity) + 20)', 'diversity_by_id', 6)}
FROM priced GROUP BY id""", {"priced": _PRICED})
_q("agg_item_stats", f"""
SELECT p.item, CAST(sum(purchasequantity) AS BIGINT) AS n_all_purchases_by_item, CAST(sum(purchaseamount) AS DOUBLE) AS spend_all_by_item,
       count(DISTINCT id) AS n_unique_by_item, count(*) AS n_tot_by_item, {_r('any_value(m_item)', 'mean_price_by_item')},
       {_r('quantile_cont(price, 0.5)', 'med_price_by_item')},
       {_r('CAST(count(DISTINCT id) + 100 AS DOUBLE) / (count(*) + 1000)', 'diversity_by_item')}
FROM priced p JOIN item_mean m ON m.item = p.item GROUP BY p.item""", _ITEM_MEAN)
_q("discount_pct", f"""
SELECT id, item, {_r('m_own', 'mean_price_by_id_item')}, {_r('m_item', 'mean_price_by_item')},
       {_r('gap', 'price_discount')}, {_r('pct', 'price_discount_percent')} FROM discounts""", _DISCOUNTS)
_q("discount_by_customer", f"""
SELECT h.id, h.repeater, {_r('d', 'mean_discount_percent')} FROM history_train h LEFT JOIN (
  SELECT id, avg(d) AS d FROM (SELECT id, family, avg(pct) AS d FROM discounts GROUP BY id, family) GROUP BY id) a
ON a.id = h.id""", _DISCOUNTS)
_q("item_stats_window", """
SELECT 'item' AS kind, item_id AS key, item_total AS total, item_amount AS amount, item_quantity AS quantity FROM items
UNION ALL SELECT 'category', category_id, category_total, category_amount, category_quantity FROM categories""", _ITEMS)
_q("item_price_ratios", "SELECT item_id, " + ", ".join(
    _r(c, c) for c in ("item_popularity", "item_avg_cost", "category_avg_cost", "item_avg_cost_div_by_category_avg_cost")
) + " FROM ratios", _ITEMS)
_q("match_counts", """
SELECT h.id, count(m.txn_seq) AS n_tot, count(*) FILTER (WHERE m_category) AS n_category, count(*) FILTER (WHERE m_chain) AS n_chain,
       count(*) FILTER (WHERE m_brand) AS n_brand, count(*) FILTER (WHERE m_company) AS n_company
FROM history_base h JOIN offers f ON f.offer = h.offer LEFT JOIN matched m ON m.id = h.id GROUP BY h.id""", {"matched": _MATCHED})
_q("match_audit", """
SELECT count(DISTINCT id) AS unique_shoppers,
       count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT id FROM history_train)) AS without_offer FROM transactions""")
_q("buy_history", _buy_history(_ALL), {"matched": _MATCHED})
_q("buy_history_dept", _buy_dept(_ALL), {"matched": _MATCHED, "firsts": _FIRSTS})
_q("never_bought", "SELECT id, never_bought_company, never_bought_category, never_bought_brand, never_bought_dept FROM feature_table", _FEATURES)
_q("cross_flags", "SELECT id, has_bought_brand_company_category, has_bought_brand_category, has_bought_brand_company, "
   "has_bought_brand_dept, has_bought_company_dept FROM feature_table", _FEATURES)
_q("offer_context", _CONTEXT)
_q("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM offered"
    for c in ("chain", "offer", "market", "category", "company", "offervalue", "brand")))
_q("repeat_score_stats", f"""
SELECT s.repeattrips, count(*) AS n, {_r('any_value(m)', 'score_mean', 6)},
       {_r('ln(2.0 + s.repeattrips) / ln(2)', 'scaled_trips', 6)}, {_r('stddev_samp(score) / sqrt(count(*))', 'score_mean_err', 6)}
FROM scores s JOIN trimmed t ON t.repeattrips = s.repeattrips GROUP BY s.repeattrips HAVING count(*) > 10""",
   {**_FACTORS, "scores": _MF_TRAIN, "trimmed": _trimmed("scores", "repeattrips", "score", 100, "m")})
_q("pair_counts", f"SELECT user_idx, item_idx, n, {_r('value', 'value', 6)} FROM pair_counts", _PAIR_COUNTS)

_q("trip_gaps", f"""
SELECT id, {_r('avg(gap)', 'mean_gap')}, {_r('stddev_pop(gap)', 'sd_gap')}, CAST(min(gap) AS INT) AS min_gap, CAST(max(gap) AS INT) AS max_gap,
       count(*) AS n_trips, count(*) FILTER (WHERE gap > 33) AS n_long_gaps,
       {_r('CAST(count(*) FILTER (WHERE gap > 33) AS DOUBLE) / count(*)', 'long_ratio')}
FROM (SELECT id, date_diff('day', lag(date) OVER (PARTITION BY id ORDER BY date), date) AS gap
      FROM (SELECT DISTINCT id, date FROM transactions)) GROUP BY id HAVING count(gap) > 1""")
_q("first_per_group", f"SELECT {_item('id')} || '_' || {_CB} AS id_item, min(id) AS id, min({_CB}) AS item FROM transactions GROUP BY 1")
_q("trimmed_mean", f"SELECT family AS item_family, {_r('m', 'mean_price')} FROM t",
   {"priced": _PRICED, "t": _trimmed("priced", "family", "price", 20, "m")})
_q("dept_first_match", """
SELECT id, dept, date AS first_date, txn_seq AS first_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY id, dept ORDER BY date, txn_seq) AS rn
  FROM matched WHERE m_company AND m_category AND m_brand) WHERE rn = 1""", {"matched": _MATCHED})
_q("cumulative_tp_fp", "SELECT score, tp, fp FROM roc", {**_SCORED, **_roc("scored")})
_q("sorted_lists", f"SELECT cluster, num_train, num_train_repeat, {_r('frac', 'frac_repeater', 6)} FROM cluster_stats ORDER BY frac, cluster", _CLUSTERS)
_q("time_ordered_split", """
SELECT id, offerdate, CASE WHEN row_number() OVER (ORDER BY offerdate, id) <= floor(count(*) OVER () * CAST(0.67 AS DOUBLE))
       THEN 'train' ELSE 'cv' END AS part FROM history_train""")

_q("union_train_test", """
SELECT id, chain, offer, market, repeattrips, repeater, offerdate FROM history_train
UNION ALL SELECT id, chain, offer, market, NULL, NULL, offerdate FROM history_test""")
_q("union_classes", "SELECT id, offer, repeater FROM history_train")
_q("union_keys", f"SELECT DISTINCT {_CCB} AS item FROM offered")
_q("except_ids", "SELECT id FROM history_test EXCEPT SELECT id FROM reduced")

_q("entropy_importance", f"""
SELECT feature, {_r('-sum(CASE WHEN pos > 0 THEN p * ln(p) ELSE 0 END)', 'entropy')}, count(*) AS n_values,
       {_r('-sum(CASE WHEN pos > 0 THEN p * ln(p) ELSE 0 END) / count(*)', 'normalized')}
FROM (SELECT *, CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) / (SELECT count(*) FROM offered) ELSE 1 END AS p FROM counts) GROUP BY feature""",
   {"counts": _counts(_ENTROPY)})
_q("chi_square", f"""
SELECT feature, {_r('sum((pos - e_pos) * (pos - e_pos) / e_pos + (n - pos - e_neg) * (n - pos - e_neg) / e_neg)', 'statistic')},
       count(*) - 1 AS df FROM expected GROUP BY feature""", _EXPECTED)
_q("chi_residuals", f"SELECT feature, value, {_r('(pos - e_pos) / sqrt(e_pos)', 'residual')} FROM expected", _EXPECTED)
_q("bayes_rollup", """
SELECT CAST(4 - bit_count(CAST(grouping(offer, chain, market, offerdate) AS BIGINT)) AS INT) AS depth, offer, chain, market, offerdate, count(*) AS n,
       count(*) FILTER (WHERE repeater = 't') AS pos FROM history_train GROUP BY ROLLUP (offer, chain, market, offerdate)""")
_q("bayes_shrink", _shrink_body(), _shrink_ctes())
_q("nb_item", f"SELECT item, n_repeat, n_norepeat, {_r(_NB_P, 'p_repeat', 6)} FROM nb_counts, nb_totals", _NB)
_q("nb_score", f"SELECT part, id, {_r('p', 'p_repeat', 6)} FROM (" + _nb_scored(
    "SELECT a.part, a.id, f.category, f.company, f.brand FROM (SELECT 'train' AS part, id, offer FROM history_train "
    "UNION ALL SELECT 'test', id, offer FROM history_test) a JOIN offers f ON a.offer = f.offer") + ")", _NB)
_q("dependence_pairs", f"""
SELECT col_a, col_b, count(*) AS n_cells,
       {_r('sum(CAST(n AS DOUBLE) / n_all * ln(CAST(n AS DOUBLE) * n_all / (CAST(n_a AS DOUBLE) * n_b)))', 'mutual_information', 6)}
FROM (SELECT *, sum(n) OVER (PARTITION BY col_a, col_b, val_a) AS n_a, sum(n) OVER (PARTITION BY col_a, col_b, val_b) AS n_b,
             sum(n) OVER (PARTITION BY col_a, col_b) AS n_all FROM cells) GROUP BY col_a, col_b""",
   {"with_item": f"SELECT *, {_CB} AS item FROM offered", "cells": _PAIR_CELLS})

_q("roc_curve", _ROC_BODY, {**_SCORED, **_roc("scored")})
_q("auroc", f"""
SELECT model, {_r('sum(neg * (before + pos / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg))', 'auroc', 6)} FROM (
  SELECT model, pos, neg, coalesce(sum(pos) OVER (PARTITION BY model ORDER BY score DESC
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM points) GROUP BY model""", {
    **_SCORED, **_NB,
    "all_scores": "SELECT 'factors' AS model, score, actual FROM scored UNION ALL SELECT 'item', round(p, 6), "
            "CASE WHEN repeater = 't' THEN 1 ELSE 0 END FROM (" + _nb_scored("SELECT * FROM offered") + ")",
    "points": "SELECT model, score, sum(actual) AS pos, sum(1 - actual) AS neg FROM all_scores GROUP BY model, score"})
_q("confusion_at_threshold", _QUALITY, _means((0.1,)))
_q("threshold_sweep", _QUALITY, _means(tuple(0.1 + 0.15 * i for i in range(7))))
_q("sparse_threshold_stats", "SELECT " + ", ".join(
    _r(c, c, 6) for c in ("threshold", "mean_data", "mean_sim", "mean_cross")) + " FROM means", _means((0.1,)))

_q("minmax_scale", "SELECT id, " + ", ".join(
    _minmax(c) for c in ("productsize", "purchasequantity", "purchaseamount", "offervalue")) + " FROM frame", _FRAMES)
_q("model_frame", "SELECT * EXCLUDE (offerdate) FROM frame WHERE label <> 0.5", _FRAMES)
_q("balance_classes", """
SELECT id, repeater, k AS shuffle_key FROM (
  SELECT id, repeater, md5(CAST(id AS VARCHAR)) AS k,
         row_number() OVER (PARTITION BY repeater ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn FROM history_train)
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM history_train GROUP BY repeater))""")

_PRODUCTS = [f"u[{i + 1}] * v[{i + 1}]" for i in range(_DIM)]
_q("mf_features", "SELECT id, unknown, " + ", ".join(
    _r(p, f"MF{i}", 6) for i, p in enumerate(_PRODUCTS)) + " FROM mf", _FACTORS)
_q("mf_super_features", "SELECT id, " + " || ',' || ".join(
    f"printf('%.6f', {x})" for x in (*[f"u[{i}]" for i in range(1, _DIM + 1)], *[f"v[{i}]" for i in range(1, _DIM + 1)], *_PRODUCTS, _DOT)
) + " AS super_features FROM mf", _FACTORS)
_q("mf_add_columns", "SELECT id, offer, " + ", ".join(
    f"printf('%.6f', {p}) AS MF{i}" for i, p in enumerate(_PRODUCTS)) + f", printf('%.6f', {_DOT}) AS score FROM mf", _FACTORS)
_q("mf_score_train", f"SELECT id, {_r('least(greatest(score, 1e-8), 10.0)', 'score', 6)} FROM ({_MF_TRAIN})", _FACTORS)
_q("kmeans_calibrate", f"SELECT cluster, num_train, num_train_repeat, {_r('frac', 'frac_repeater', 6)} FROM cluster_stats", _CLUSTERS)
_FRAC = "(CAST(sum(hit) + 10 AS DOUBLE) / (count(*) + CAST(10.0 AS DOUBLE) / CAST(0.3 AS DOUBLE)))"
_q("kmeans_random_control", f"""
SELECT control, cluster, count(*) AS num_train, CAST(sum(hit) AS BIGINT) AS num_train_repeat, {_r(_FRAC, 'frac_repeater', 6)} FROM (
  SELECT 'random_label' AS control, cluster, CASE WHEN {_digits('id')} / 4294967296.0 < 0.3 THEN 1 ELSE 0 END AS hit FROM clustered
  UNION ALL SELECT 'permuted_cluster', b.cluster, CASE WHEN a.repeater = 't' THEN 1 ELSE 0 END
  FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS rn FROM clustered) a
  JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster, id) AS rn FROM clustered) b ON a.rn = b.rn)
GROUP BY control, cluster""", _CLUSTERS)
_plain = "CAST(num_train_repeat AS DOUBLE) / num_train"
_q("cluster_error", f"SELECT cluster, {_r(_plain, 'frac_repeat', 6)}, {_r(f'1 / sqrt(num_train * ({_plain}))', 'frac_err', 6)} FROM cluster_stats",
   _CLUSTERS)
_q("cluster_score_roc", _ROC_BODY, {
    **_CLUSTERS,
    "scored": "SELECT round(frac + 1e-9, 6) AS score, CASE WHEN repeater = 't' THEN 1 ELSE 0 END AS actual "
              "FROM clustered c JOIN cluster_stats s ON c.cluster = s.cluster",
    **_roc("scored")})
_q("cluster_outputs", f"""
SELECT part, id, a.cluster, {_r('frac', 'frac_repeater')},
       CASE WHEN part = 'test' THEN round(frac * 100 + 1e-9, 4) END AS "repeatProbability"
FROM (SELECT 'train' AS part, id, cluster FROM clustered
      UNION ALL SELECT 'test', h.id, e.label FROM history_test h JOIN embeddings e ON e.vec_id = 2 * (h.id % {_HALF})) a
JOIN cluster_stats s ON a.cluster = s.cluster""", _CLUSTERS)


# ---- read back, encoded and fitted: exact where the output is defined, else what any good fit fulfils

_q("src_transactions", "SELECT * EXCLUDE (txn_seq, company, productsize, purchaseamount), CAST(company AS BIGINT) AS company, "
   "CAST(productsize AS DOUBLE) AS productsize, CAST(purchaseamount AS DOUBLE) AS purchaseamount FROM transactions")
_q("src_partfiles", _BODIES["src_transactions"][0])
_q("src_inferred", "SELECT * FROM history_test")
_q("src_triples", f"SELECT user_idx, item_idx, {_r('value', 'value', 6)} FROM pair_counts", _PAIR_COUNTS)
_q("src_predictions", "SELECT CAST(printf('%.6f', p) AS DOUBLE) AS score, id FROM ("
   + _nb_scored("SELECT h.id, f.category, f.company, f.brand FROM history_test h JOIN offers f ON h.offer = f.offer") + ")", _NB)
_NUMBERED = {
    "ccb": _PAIR_COUNTS["ccb"],
    "users": f"SELECT id, CAST(dense_rank() OVER (ORDER BY id) AS INT) AS user_idx, {_log_scale('n')} AS value FROM ccb",
}
_CATEGORICAL = ("chain", "offer", "market", "category", "company", "brand")
_CONTINUOUS = ("productsize", "purchasequantity", "purchaseamount", "offervalue")
_SLOTS = {
    **_FRAMES,
    **{f"slots_{c}": f"SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS slot "
                     f"FROM frame WHERE label <> 0.5 GROUP BY {c}" for c in _CATEGORICAL},
}
_SLOT_JOINS = " ".join(f"LEFT JOIN slots_{c} ON f.{c} = slots_{c}.{c}" for c in _CATEGORICAL)
_q("one_hot", "SELECT f.id, " + ", ".join(f"coalesce(slots_{c}.slot, -1) AS {c}_slot" for c in _CATEGORICAL) + f" FROM frame f {_SLOT_JOINS}", _SLOTS)
_WIDTHS = [f"(SELECT count(*) FROM slots_{c})" for c in _CATEGORICAL]
_q("assemble", "SELECT f.id, CASE WHEN f.label <> 0.5 THEN f.label END AS label, concat_ws(',', "
   + ", ".join(f"slots_{c}.slot + {' + '.join(['0', *_WIDTHS[:i]])}" for i, c in enumerate(_CATEGORICAL)) + ") AS slots, "
   + f"CAST({' + '.join(_WIDTHS)} + {len(_CONTINUOUS)} AS INT) AS n_features, "
   + ", ".join(_r(f"CASE WHEN l.hi_{c} = l.lo_{c} THEN 0.5 ELSE (f.{c} - l.lo_{c}) / (l.hi_{c} - l.lo_{c}) END", c, 6) for c in _CONTINUOUS)
   + f" FROM frame f {_SLOT_JOINS}, limits l",
   {**_SLOTS, "limits": "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _CONTINUOUS) + " FROM frame WHERE label <> 0.5"})
_q("interact_hash", "SELECT id, " + ", ".join(
    f"{_digits(_item(a, b))} AS {a}_x_{b}" for a, b in combinations(_CATEGORICAL, 2)) + " FROM frame", _FRAMES)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (body, own) in _BODIES.items():
        ctes = {**_CTES, **own}
        out[name] = "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes.items()) + "\n" + body.strip()
    return out
