"""The same queries as plain SQL on the given tables, for comparison."""

from __future__ import annotations

from reelmill.params import GENERIC_TERMS, NEGATIVE_PHRASES, POSITIVE_PHRASES, STOP_WORDS

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(col: str, pattern: str, to: str) -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(to)}, 'g')"


def phrases(col: str) -> str:
    for phrase, token in POSITIVE_PHRASES + NEGATIVE_PHRASES:
        col = f"replace({col}, {q(phrase)}, {q(token)})"
    return col


def clean(col: str) -> str:
    text = sub(sub(f"lower({col})", r"<[^>\n]*>", " "), rf"https?://[^{SPACE}]+", " ")
    return f"trim({sub(phrases(text), r'[^a-zA-Z' + chr(39) + ']+', ' ')})"


def words(col: str, raw: bool = False) -> str:
    if raw:
        col = sub(sub(f"lower({col})", r"[^\p{L}\p{N}\x{00}-\x{7f}]", " "), r"[^\x{00}-\x{7f}]", "0")
    stop = "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"
    found = f"regexp_extract_all({col}, {q(chr(92) + 'b[a-zA-Z' + chr(39) + '][a-zA-Z' + chr(39) + ']+' + chr(92) + 'b')})"
    return f"list_filter({found}, lambda w: NOT list_contains({stop}, w))"


def grams(t: str) -> str:
    two = f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i+1])"
    three = f"list_transform(range(1, len({t})-1), lambda i: {t}[i] || ' ' || {t}[i+1] || ' ' || {t}[i+2])"
    return f"list_concat(list_concat({t}, {two}), {three})"


def title_key(col: str, fixed: bool = False) -> str:
    key = sub(f"lower({col})", r"\(\d{4}\)", "")
    return sub(sub(key, r"\([ivx]+\)" if fixed else r"\([IVX]+\)", ""), r"[^a-z0-9]", "")


def stars(col: str) -> str:
    n = f"CAST(round_even(({col})::DOUBLE / 2, 0) AS INTEGER)"
    return f"repeat('⭐', {n}) || repeat('☆', 5 - {n})"


GENERIC = "(" + ", ".join(q(t) for t in GENERIC_TERMS) + ")"

# --- shared sub-queries; each lists the ones it needs before it ----------------

CTE = {
    "rev": """SELECT d.doc_id AS review_id, d.source AS item, d.doc_id % 50 AS "user",
        (CASE l.quality WHEN 1 THEN 7 + d.doc_id % 4 WHEN 0 THEN 1 + d.doc_id % 4 ELSE 5 + d.doc_id % 2 END)::DOUBLE AS rating,
        d.text AS review, coalesce(l.toxic, 0) AS spoiler_tag
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "cl": f"SELECT *, {clean('review')} AS clean_text FROM rev",
    "lab": """SELECT *, CASE WHEN rating >= 7 THEN 1 WHEN rating <= 4 THEN 0 ELSE -1 END AS label
        FROM cl WHERE clean_text <> '' AND len(string_split(clean_text, ' ')) BETWEEN 10 AND 2000""",
    "tr": "SELECT * FROM lab WHERE label <> -1 AND spoiler_tag = 0",
    "tok": f"SELECT review_id, {words('clean_text')} AS t FROM tr",
    "tfc": f"SELECT review_id, term, count(*) AS tf FROM (SELECT review_id, unnest({grams('t')}) AS term FROM tok) GROUP BY ALL",
    "st": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tfc GROUP BY term",
    "vocab": """SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, ctf,
        ln(((SELECT count(*) FROM tr) + 1) / (df + 1)) + 1 AS idf
        FROM (SELECT * FROM st WHERE df >= 3 AND df <= 0.9 * (SELECT count(*) FROM tr) ORDER BY ctf DESC, term LIMIT 50000)""",
    "dt": """SELECT review_id, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY review_id)) AS weight
        FROM (SELECT review_id, term_id, (1 + ln(tf)) * idf AS x FROM tfc JOIN vocab USING (term))""",
    "pr": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n_item FROM lab WHERE label = 1 AND spoiler_tag = 0)
        WHERE n_item >= 3""",
    "it": """SELECT item, term_id, sum(ln(rating + 1) / ln(11) * weight) AS weight FROM pr JOIN dt USING (review_id) GROUP BY ALL""",
    "inorm": "SELECT item, sqrt(sum(weight * weight)) AS norm, count(*) AS n_terms FROM it GROUP BY item",
    "qtf": f"""SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({grams('t')}) AS term
        FROM (SELECT item_id AS query_id, {words('text', True)} AS t FROM benchmark)) GROUP BY ALL""",
    "qt": """SELECT query_id, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS weight
        FROM (SELECT query_id, term_id, (1 + ln(tf)) * idf AS x FROM qtf JOIN vocab USING (term))""",
    "qc": """SELECT * FROM (SELECT query_id, item, round(sum(q.weight * i.weight) / any_value(n.norm), 9) AS cos
        FROM qt q JOIN it i USING (term_id) JOIN inorm n USING (item) GROUP BY query_id, item) WHERE cos > 0""",
    "qpool": """SELECT * FROM qc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item) <= 150""",
    "ev": """SELECT event_id, ts, user_id AS "user", 'src' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 25) AS item,
        CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'unlike' WHEN 'purchase' THEN 'rate' WHEN 'error' THEN 'delete' ELSE 'none' END AS action,
        CAST(floor(value) % 10 + 1 AS INTEGER) AS rating, 'note ' || event_id AS review FROM events""",
    "lf": """SELECT "user", item, action IN ('like', 'rate') AS favorite FROM ev WHERE action <> 'none'
        QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC) = 1""",
    "lr": """SELECT "user", item, CASE WHEN action = 'rate' THEN rating END AS rating, CASE WHEN action = 'rate' THEN review END AS review
        FROM ev WHERE action IN ('rate', 'delete')
        QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC) = 1""",
    "state": """SELECT lf."user", lf.item, favorite, rating, review FROM lf LEFT JOIN lr ON lf."user" = lr."user" AND lf.item = lr.item""",
    "fav": """SELECT "user", item, rating FROM state WHERE favorite""",
    "taste": """SELECT "user", term_id, sum(w * weight) / any_value(tw) AS weight FROM
        (SELECT "user", item, coalesce(rating, 10) / 10.0::DOUBLE AS w, sum(coalesce(rating, 10) / 10.0::DOUBLE) OVER (PARTITION BY "user") AS tw
         FROM fav WHERE item IN (SELECT item FROM inorm)) JOIN it USING (item) GROUP BY "user", term_id""",
    "tnorm": """SELECT "user", sqrt(sum(weight * weight)) AS norm FROM taste GROUP BY "user" """,
    "tc": """SELECT t."user", i.item, round(sum(t.weight * i.weight) / any_value(tn.norm) / any_value(n.norm), 9) AS cos
        FROM taste t JOIN it i USING (term_id) JOIN tnorm tn ON tn."user" = t."user" JOIN inorm n ON n.item = i.item GROUP BY t."user", i.item""",
    "spool": """SELECT tc."user" AS query_id, tc.item, cos FROM tc LEFT JOIN fav ON tc."user" = fav."user" AND tc.item = fav.item
        WHERE fav.item IS NULL AND cos > 0 QUALIFY row_number() OVER (PARTITION BY tc."user" ORDER BY cos DESC, tc.item) <= 200""",
    "inter": """SELECT o_custkey AS "user", l_partkey AS item, (l_quantity % 10 + 1)::DOUBLE AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "cell": """SELECT "user", item, sum(rating) AS r FROM inter GROUP BY ALL""",
    "cat": """SELECT p_partkey::VARCHAR AS tconst, CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'SMALL' THEN 'tvSeries' ELSE 'videoGame' END AS "titleType",
        p_name || ' ' || p_brand AS "primaryTitle", upper(p_name || ' ' || p_brand) AS "originalTitle", (p_size + 1975)::DOUBLE AS year FROM part""",
    "fcat": """SELECT * FROM cat WHERE "titleType" IN ('movie', 'tvSeries', 'tvMovie', 'short') AND year BETWEEN 1980 AND 2010""",
    "tkeys": f"""SELECT DISTINCT title_key FROM (SELECT {title_key('"primaryTitle"')} AS title_key FROM fcat
        UNION ALL SELECT {title_key('"originalTitle"')} FROM fcat) WHERE title_key <> ''""",
    "trev": """SELECT l_orderkey, l_linenumber, upper(p_name || ' ' || p_brand) || ' (1999)' AS item, l_quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "kept": f"SELECT * FROM trev WHERE {title_key('item')} IN (SELECT title_key FROM tkeys)",
    "pred": """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, (l_linenumber % 3)::INTEGER AS prediction,
        l_discount AS s0, l_tax AS s1, l_quantity % 7 + l_discount AS s2 FROM lineitem""",
    "cm": "SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL",
    "pc": """SELECT c AS label, sum(tp) AS tp, sum(support) AS support,
        CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted) ELSE 0 END AS precision,
        CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0 END AS recall
        FROM (SELECT label AS c, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cm
              UNION ALL SELECT prediction, 0, n, 0 FROM cm) GROUP BY c""",
    "pcf": """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc""",
    "emb": "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings",
    "dcos": """SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 9) AS cos
        FROM emb a, emb b""",
}
NEEDS = {
    "cl": ["rev"], "lab": ["cl"], "tr": ["lab"], "tok": ["tr"], "tfc": ["tok"], "st": ["tfc"], "vocab": ["st"], "dt": ["vocab"],
    "pr": ["lab"], "it": ["pr", "dt"], "inorm": ["it"], "qt": ["qtf", "vocab"], "qc": ["qt", "inorm"], "qpool": ["qc"],
    "lf": ["ev"], "lr": ["ev"], "state": ["lf", "lr"], "fav": ["state"], "taste": ["fav", "inorm"], "tnorm": ["taste"],
    "tc": ["tnorm"], "spool": ["tc"], "cell": ["inter"], "fcat": ["cat"], "tkeys": ["fcat"], "kept": ["trev", "tkeys"],
    "cm": ["pred"], "pc": ["cm"], "pcf": ["pc"], "dcos": ["emb"],
}


def with_(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the named sub-queries and all they need, then ``extra`` ones in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in NEEDS.get(name, []):
                add(other)
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


# Test draws: md5 of seed and key, cut by rank.
def h(seed: object, key: str) -> str:
    return f"md5('{seed}-' || {key})"


def scaled(col: str, part: str) -> str:
    lo, hi = f"min({col}) OVER (PARTITION BY {part})", f"max({col}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {hi} - {lo} < 1e-9 THEN 1.0 ELSE ({col} - {lo}) / ({hi} - {lo}) END"


ROUNDED = """round(cos, 6) AS cos, round(pers_raw, 6) AS pers_raw, round(cos_norm, 6) AS cos_norm,
    round(pers_norm, 6) AS pers_norm, round(final, 6) AS final"""


def guest(pool: str) -> dict[str, str]:
    """Blend of a pool nobody is known for: content alone."""
    return {
        "sc": f"SELECT *, false AS is_pers, 0.0 AS pers_raw, {scaled('cos', 'query_id')} AS cos_norm, 1.0 AS pers_norm FROM {pool}",
        "bl": "SELECT *, round(cos_norm, 9) AS final FROM sc",
    }


def three_picks(pool: str, sim: str, item: str, score: str) -> dict[str, str]:
    """Three MMR steps written out; pools of at most three keep their order."""
    w = f"OVER (PARTITION BY query_id ORDER BY v DESC, {score} DESC, {item})"
    return {
        "m0": f"SELECT *, count(*) OVER (PARTITION BY query_id) AS pool_n, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {item}) AS place FROM {pool}",
        "p1": "SELECT * FROM m0 WHERE place = 1",
        "m1": f"SELECT m.*, coalesce(s.s, 0) AS s1 FROM m0 m JOIN p1 USING (query_id) LEFT JOIN {sim} s ON s.a = m.{item} AND s.b = p1.{item} WHERE m.place > 1",
        "p2": f"SELECT * FROM (SELECT *, row_number() {w} AS rn FROM (SELECT *, CASE WHEN pool_n <= 3 THEN -place::DOUBLE ELSE round(0.6 * {score} - 0.4 * s1, 9) END AS v FROM m1)) WHERE rn = 1",
        "m2": f"SELECT m.*, greatest(s1, coalesce(s.s, 0)) AS s2 FROM m1 m JOIN p2 ON p2.query_id = m.query_id LEFT JOIN {sim} s ON s.a = m.{item} AND s.b = p2.{item} WHERE m.{item} <> p2.{item}".replace("greatest(s1,", "greatest(m.s1,"),
        "p3": f"SELECT * FROM (SELECT *, row_number() {w} AS rn FROM (SELECT *, CASE WHEN pool_n <= 3 THEN -place::DOUBLE ELSE round(0.6 * {score} - 0.4 * s2, 9) END AS v FROM m2)) WHERE rn = 1",
    }


def picks(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, {i} AS rank FROM p{i}" for i in (1, 2, 3))


ISIM = {"isim": """SELECT a.item AS a, b.item AS b, round(sum(a.weight * b.weight) / any_value(na.norm) / any_value(nb.norm), 9) AS s
    FROM it a JOIN it b USING (term_id) JOIN inorm na ON na.item = a.item JOIN inorm nb ON nb.item = b.item GROUP BY a.item, b.item"""}

AUC = "CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)) END"


def auc(source: str, label: str, score: str) -> str:
    return f"""SELECT {AUC} AS auc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {score} AS s, count(*) FILTER (WHERE {label}) AS p, count(*) FILTER (WHERE NOT {label}) AS n FROM {source} GROUP BY s))"""


def user_metrics() -> dict[str, str]:
    return {
        "ranked": 'SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY item) AS rank FROM cell QUALIFY rank <= 10',
        "rel": 'SELECT "user", count(*) AS n FROM cell WHERE r >= 7 GROUP BY "user"',
        "um": """SELECT rel."user", """ + ", ".join(
            f"""count(*) FILTER (WHERE r >= 7 AND rank <= {k}) / {k}.0 AS precision_{k},
            coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE r >= 7 AND rank <= {k}), 0)
              / list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}""" for k in (5, 10)
        ) + """ FROM rel LEFT JOIN ranked ON rel."user" = ranked."user" GROUP BY rel."user" """,
    }


MESSY_EXTRA = """CASE doc_id % 3 WHEN 0 THEN 'A MUST see, not worthy; well done <br/> https://a.b/c?d too long'
    WHEN 1 THEN 'waste of time and waste of money, edge of my seat' ELSE 'fell asleep' END"""

def offline(limit: str = "", holdout: float | None = None) -> str:
    """Mean list metrics of users; with ``holdout`` that share of the rows is for the ground truth only."""
    held = "false" if holdout is None else f"('0x' || substr({h('holdout-42', 'review_id')}, 1, 8))::BIGINT / 4294967296.0 < {holdout}"
    truth, mine = ("true", "true") if holdout is None else ("held", "NOT held")
    unseen = "true" if holdout is None else 'NOT EXISTS (SELECT 1 FROM pw WHERE pw."user" = ua."user" AND pw.item = ua.item)'
    return with_(["lab", "inorm"], """SELECT """ + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10) for m in ("precision", "ndcg")) + """,
        round(avg(ild), 6) AS ild, count(*) AS n_users_evaluated, (SELECT count(*) FROM us) AS n_users_sampled FROM um JOIN il ON il."user" = um."user" """, {
        "kn": 'SELECT review_id, "user", item, rating FROM lab WHERE item IN (SELECT item FROM inorm)',
        "us": f'SELECT "user" FROM kn GROUP BY "user" HAVING count(*) >= 3 ORDER BY {h(42, chr(34) + "user" + chr(34))} {limit}',
        "rw": f'SELECT *, {held} AS held FROM kn WHERE "user" IN (SELECT "user" FROM us)',
        "re0": f'SELECT DISTINCT "user", item FROM rw WHERE rating >= 7 AND {truth}',
        "pw": f'SELECT * FROM rw WHERE "user" IN (SELECT "user" FROM re0) AND {mine}',
        "uv": 'SELECT "user", term_id, sum(weight) AS weight FROM pw JOIN it USING (item) GROUP BY "user", term_id',
        "rel": 'SELECT * FROM re0 WHERE "user" IN (SELECT "user" FROM uv)',
        "un": 'SELECT "user", sqrt(sum(weight * weight)) AS norm FROM uv GROUP BY "user"',
        "uc": 'SELECT uv."user", it.item, round(sum(uv.weight * it.weight) / any_value(un.norm) / any_value(inorm.norm), 9) AS cos FROM uv JOIN it USING (term_id) JOIN un ON un."user" = uv."user" JOIN inorm ON inorm.item = it.item GROUP BY uv."user", it.item',
        "ua": 'SELECT un."user", inorm.item, coalesce(uc.cos, 0) AS cos FROM un CROSS JOIN inorm LEFT JOIN uc ON uc."user" = un."user" AND uc.item = inorm.item',
        "rk": f'SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY cos DESC, item) AS rank FROM ua WHERE {unseen} QUALIFY rank <= 10',
        "rn": 'SELECT "user", count(*) AS n FROM rel GROUP BY "user"',
        "um": """SELECT rn."user", """ + ", ".join(
            f"""count(rel.item) FILTER (WHERE rank <= {k}) / {k}.0 AS precision_{k},
            coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel.item IS NOT NULL AND rank <= {k}), 0)
              / list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}""" for k in (5, 10)
        ) + """ FROM rn LEFT JOIN rk ON rn."user" = rk."user" LEFT JOIN rel ON rel."user" = rk."user" AND rel.item = rk.item GROUP BY rn."user" """,
        **ISIM,
        "il": """SELECT a."user", 1 - avg(coalesce(s.s, 0)) AS ild FROM rk a JOIN rk b ON a."user" = b."user" AND a.item < b.item
            LEFT JOIN isim s ON s.a = a.item AND s.b = b.item GROUP BY a."user" """,
    })


def prepared(published_order: bool) -> str:
    """Reviews of titles in the catalogue, cleaned; the classifier's rows are balanced, or all are, first."""
    named = "SELECT * FROM rev WHERE regexp_replace(item, '[^a-z0-9]', '', 'g') IN (SELECT 'src' || p_partkey % 25 FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size + 1975 BETWEEN 1980 AND 1982)"
    balanced = f"""SELECT review_id FROM (SELECT *, row_number() OVER (PARTITION BY rating >= 7 ORDER BY {h(42, 'review_id')}, review_id) AS r FROM pool)
        WHERE rating <= 4 OR r <= floor((SELECT count(*) FROM pool WHERE rating <= 4) * 1.5)"""
    kept = f"""SELECT *, {clean('review')} AS clean_text, CASE WHEN rating >= 7 THEN 1 WHEN rating <= 4 THEN 0 ELSE -1 END AS label FROM named
        {"WHERE review_id IN (SELECT review_id FROM b)" if published_order else ""}"""
    parts = {"named": named}
    if published_order:
        parts |= {"pool": "SELECT * FROM named WHERE rating >= 7 OR rating <= 4", "b": balanced}
    parts["lb"] = f"SELECT * FROM ({kept}) WHERE clean_text <> '' AND len(string_split(clean_text, ' ')) BETWEEN 10 AND 2000"
    if not published_order:
        parts |= {"pool": "SELECT * FROM lb WHERE label <> -1 AND spoiler_tag = 0", "b": balanced}
    return with_(["rev"], """SELECT review_id, item, "user", rating, label, label <> -1 AND spoiler_tag = 0 AND review_id IN (SELECT review_id FROM b) AS is_training, md5(clean_text) AS text_md5 FROM lb""", parts)


def split(rows: str) -> dict[str, str]:
    """l (review_id, label, r) and c (label, n, train): the parts of a stratified 80/20 split."""
    return {
        "l": f"SELECT review_id, label, row_number() OVER (PARTITION BY label ORDER BY {h(42, 'review_id')}, review_id) AS r FROM {rows}",
        "s": "SELECT label, n, n * (sum(n) OVER () - ceil(sum(n) OVER () * 0.2)) / sum(n) OVER () AS share, sum(n) OVER () - ceil(sum(n) OVER () * 0.2) AS t FROM (SELECT label, count(*)::DOUBLE AS n FROM l GROUP BY label)",
        "c": "SELECT label, n, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label) <= t - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS train FROM s",
    }


ORACLE: dict[str, str] = {
    "loaded_review_parts": with_(["rev"], 'SELECT review_id, item, "user"::VARCHAR AS "user", rating, md5(review) AS text_md5 FROM rev'),
    "loaded_catalogue": """SELECT p_partkey::VARCHAR AS tconst, CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'SMALL' THEN 'tvSeries' ELSE 'videoGame' END AS "titleType",
        CASE WHEN p_partkey % 7 <> 0 THEN p_name || ' ' || p_brand END AS "primaryTitle", '"' || upper(p_name || ' ' || p_brand) AS "originalTitle", (p_size + 1975)::VARCHAR AS "startYear" FROM part""",
    "exported_reviews": with_(["lab"], """SELECT item, "user"::VARCHAR AS "user", rating::VARCHAR AS rating, label::VARCHAR AS label, spoiler_tag::VARCHAR AS spoiler_tag, md5(review) AS review_md5, md5(clean_text) AS text_md5 FROM lab"""),
    "reloaded_vocabulary": with_(["vocab", "it"], "SELECT term, term_id, df, ctf, round(idf, 6) AS idf, (SELECT count(*) FROM it) AS n_entries FROM vocab"),
    "recorded_metrics": """WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders)
        SELECT 'mean' AS metric, NULL::INTEGER AS k, round(2 * mean, 2) AS value, 'second' AS run_id FROM m UNION ALL SELECT 'std', NULL, round(std, 2), 'first' FROM m
        UNION ALL SELECT 'top', 5, round(10 * mean, 2), 'second' FROM m UNION ALL SELECT 'top', 10, round(20 * mean, 2), 'second' FROM m""",
    "recorded_runs": """SELECT run_id, seed, mean FROM (VALUES ('first', '1'), ('second', '2')) r(run_id, seed), (SELECT round(avg(o_totalprice), 2) AS mean FROM orders)""",
    "prepared_bare_reviews": with_(["rev"], f"""SELECT review_id, label, review_id IN (SELECT review_id FROM b) AS is_training, md5(clean_text) AS text_md5 FROM lb""", {
        "lb": f"""SELECT *, CASE WHEN rating >= 7 THEN 1 WHEN rating <= 4 THEN 0 ELSE -1 END AS label FROM (SELECT *, {clean('review')} AS clean_text FROM rev)
            WHERE clean_text <> '' AND len(string_split(clean_text, ' ')) BETWEEN 10 AND 2000""",
        "b": f"""SELECT review_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(42, 'review_id')}, review_id) AS r FROM lb WHERE label <> -1)
            WHERE label = 0 OR r <= floor((SELECT count(*) FROM lb WHERE label = 0) * 1.5)""",
    }),
    "sentiment_score_checks": with_(["tr"], "SELECT review_id, l.label, r <= n - train AS is_test, true AS in_range, true AS consistent FROM l JOIN c USING (label)", split("tr")),
    "sentiment_fold_checks": "SELECT fold, true AS in_range, true AS averaged FROM (VALUES (0), (1), (2)) f(fold)",
    "given_certificate": with_(["tr", "dt"], """SELECT n.m AS model, round(0.5 * wn + loss, 5) AS primal, round(alpha - loss - 0.5 * (pn + pb * pb), 5) AS dual,
        round(sqrt(gn + (b - pb) * (b - pb)), 5) AS gradient_norm FROM n JOIN a ON a.m = n.m JOIN g ON g.m = n.m""", {
        "given": "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE), (1, 0.0, -0.2, 0.25)) v(m, scale, b, c)",
        "wt": "SELECT term_id, (term_id * 37 % 11 - 5) / 10.0::DOUBLE AS w FROM vocab",
        "f": "SELECT review_id, sum(weight * w) AS f FROM dt JOIN wt USING (term_id) GROUP BY review_id",
        "sh": "SELECT m, c, tr.review_id, 2 * label - 1 AS y, greatest(0, 1 - (2 * label - 1) * (scale * coalesce(f, 0) + b)) AS short FROM tr LEFT JOIN f USING (review_id), given",
        "a": "SELECT m, sum(c * short * short) AS loss, sum(2 * c * short) AS alpha, sum(2 * c * short * y) AS pb FROM sh GROUP BY m",
        "pt": "SELECT m, term_id, sum(2 * c * short * y * weight) AS p FROM sh JOIN dt USING (review_id) GROUP BY ALL",
        "g": "SELECT m, sum(p * p) AS pn, sum((scale * w - coalesce(p, 0)) * (scale * w - coalesce(p, 0))) AS gn FROM wt CROSS JOIN given LEFT JOIN pt USING (m, term_id) GROUP BY m",
        "n": "SELECT m, b, sum(scale * scale * w * w) + b * b AS wn FROM wt, given GROUP BY m, b",
    }),
    "fitted_certificate": "SELECT m::INTEGER AS model, true AS optimal FROM range(3) r(m)",
    "reported_lines": f"""WITH p AS (SELECT (l_returnflag = 'R')::INTEGER AS label, (l_linenumber % 2)::INTEGER AS prediction, l_discount AS probability FROM lineitem),
        c AS (SELECT k, count(*) FILTER (WHERE label = k) AS support, count(*) FILTER (WHERE label = k AND prediction = k) AS tp, count(*) FILTER (WHERE prediction = k) AS said FROM p, (VALUES (0), (1)) v(k) GROUP BY k),
        f AS (SELECT *, tp / said AS precision, tp / support AS recall, 2 * (tp / said) * (tp / support) / (tp / said + tp / support) AS f1 FROM c)
        SELECT round(sum(tp) / sum(support), 6) AS accuracy, {", ".join(f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted, round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1"))},
        (SELECT round(auc, 6) FROM ({auc('p', '(label = 1)', 'probability')})) AS roc_auc, sum(tp)::BIGINT AS n_right, sum(support)::BIGINT AS n_rows FROM f""",
    "given_variance": with_(["cell", "emb"], """SELECT round(captured / whole * 1e6, 4) AS millionths FROM
        (SELECT sum(v) AS captured FROM (SELECT var_pop(x) AS v FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM emb) GROUP BY i)),
        (SELECT sum(s2 / n - (s / n) * (s / n)) AS whole FROM (SELECT item, sum(r) AS s, sum(r * r) AS s2 FROM cell GROUP BY item), (SELECT count(DISTINCT "user") AS n FROM cell))"""),
    "factor_checks": with_(["cell"], "SELECT count(DISTINCT item) AS n_items, least(150, count(DISTINCT item)) AS width, true AS orthonormal, true AS projected FROM cell"),
    "assembled_from_seeds": with_(["spool", "fav", "inorm"], f"""SELECT r.query_id, r.item, rank::INTEGER AS rank, round(final * 100, 1) AS percent, explanation, keywords, shown
        FROM rr r LEFT JOIN ex ON ex.query_id = r.query_id AND ex.item = r.item LEFT JOIN kl ON kl.query_id = r.query_id LEFT JOIN sh ON sh.item = r.item""", {
        **guest("spool"),
        "rr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM bl QUALIFY rank <= 3",
        "ex": f"""SELECT query_id, item, string_agg(term, '|' ORDER BY k) AS explanation FROM (SELECT query_id, rr.item, term,
            row_number() OVER (PARTITION BY query_id, rr.item ORDER BY round(least(q.weight, i.weight), 9) DESC, term) AS k
            FROM rr JOIN taste q ON q."user" = rr.query_id JOIN it i ON i.item = rr.item AND i.term_id = q.term_id JOIN vocab ON vocab.term_id = q.term_id WHERE term NOT IN {GENERIC}) WHERE k <= 4 GROUP BY query_id, item""",
        "km": f"""SELECT "user", term, sum(it.weight) / any_value(n) AS weight, contains(term, ' ') AS gram
            FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS n FROM fav WHERE item IN (SELECT item FROM inorm)) f JOIN it USING (item) JOIN vocab USING (term_id)
            WHERE contains(term, ' ') OR term NOT IN {GENERIC} GROUP BY "user", term""",
        "kk": 'SELECT *, round(weight, 9) AS w, row_number() OVER (PARTITION BY "user", gram ORDER BY round(weight, 9) DESC, term) AS rn FROM km',
        "kl": """SELECT "user" AS query_id, string_agg(term, '|' ORDER BY w DESC, term) AS keywords FROM kk WHERE rn <= CASE WHEN gram THEN 7 ELSE 5 END GROUP BY "user" """,
        "cr": f"""SELECT item, row_number() OVER (PARTITION BY item ORDER BY spoiler_tag, rating DESC, review_id) AS place, "user", {stars('rating')} AS stars FROM lab WHERE label = 1 QUALIFY place <= 3""",
        "sh": """SELECT item, string_agg(place || ':' || "user" || ':' || stars, '|' ORDER BY place) AS shown FROM cr GROUP BY item""",
    }),

    "canonical_columns": with_(["rev"], "SELECT review_id, item AS movie, rating, spoiler_tag, md5(review) AS text_md5 FROM rev"),
    "coerced_reviews": with_(["rev"], """SELECT * FROM (SELECT review_id, CASE review_id % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 8.0 ELSE rating END AS rating,
        CASE review_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE spoiler_tag END::INTEGER AS spoiler_tag FROM rev WHERE review_id % 11 <> 5) WHERE rating IS NOT NULL"""),
    "cleaned_texts": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "cleaned_markup": f"SELECT page_id, {clean('''url || ' ' || html''')} AS clean_text FROM pages",
    "collapsed_phrases": with_([], f"SELECT doc_id, md5({phrases('lower(t)')}) AS text_md5, {clean('t')} AS clean_text FROM x",
        {"x": f"SELECT doc_id, text || ' ' || {MESSY_EXTRA} AS t FROM documents"}),
    "word_count_filter": with_(["lab"], "SELECT review_id, len(string_split(clean_text, ' '))::INTEGER AS n_words FROM lab"),
    "labelled_training_rows": with_(["tr"], "SELECT review_id, label, rating FROM tr"),
    "normalized_titles": with_(["trev"], f"SELECT title, {title_key('title')} AS title_key, {title_key('title', True)} AS title_key_fixed FROM (SELECT DISTINCT item || ' (II) É' AS title FROM trev)"),
    "filtered_catalogue": with_(["fcat"], 'SELECT tconst, "titleType", "primaryTitle", year FROM fcat'),
    "weighted_ratings": with_(["rev"], "SELECT review_id, round(ln(rating + 1) / ln(11), 6) AS weight FROM rev"),
    "shown_reviews": with_(["lab"], 'SELECT review_id, item, "user", rating, spoiler_tag, md5(review) AS review_md5 FROM lab WHERE label = 1'),
    "result_links": """SELECT p_partkey, item, round(final * 100, 1) AS percent, least(round(final * 100, 1), 100.0) AS bar_width,
        'https://www.youtube.com/results?search_query=' || replace(url_encode(item || ' official trailer'), '%20', '+') AS trailer_link,
        'https://www.imdb.com/find?q=' || replace(url_encode(item), '%20', '+') || '&s=tt' AS title_link
        FROM (SELECT p_partkey, p_name || ' & ' || p_brand AS item, p_retailprice / 1000 AS final FROM part)""",
    "review_snippets": with_(["rev"], f"""SELECT review_id, {stars('rating')} AS stars, length(review) > 150 AS has_more,
        CASE WHEN length(review) > 150 THEN substring(review, 1, 150) || '...' ELSE review END AS snippet FROM rev"""),
    "personalized_queries": with_(["fav"], """SELECT item_id AS query_id, kind, CASE kind WHEN 'guest' THEN false
        WHEN 'account' THEN item_id IN (SELECT "user" FROM fav) ELSE item_id IN (SELECT vec_id FROM embeddings) END AS is_pers
        FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'guest' WHEN 1 THEN 'account' ELSE 'user' END AS kind FROM benchmark)"""),
    "catalogue_matches": with_(["kept"], "SELECT l_orderkey, l_linenumber, item, l_quantity FROM kept"),
    "catalogue_retention": with_(["kept"], "SELECT (SELECT count(*) FROM trev) AS n_before, (SELECT count(*) FROM kept) AS n_after, round((SELECT count(*) FROM kept) / (SELECT count(*) FROM trev), 6) AS kept"),
    "supported_items": with_(["pr"], "SELECT item, count(*) AS n_rows FROM pr GROUP BY item"),
    "active_users": with_(["inter"], 'SELECT "user", count(*) AS n_rows FROM inter GROUP BY "user" HAVING count(*) >= 30'),
    "known_items": with_(["inter"], 'SELECT "user", count(*) AS n_known FROM inter WHERE item IN (SELECT item FROM inter GROUP BY item HAVING count(*) >= 30) GROUP BY "user"'),
    "not_yet_liked": with_(["state"], 'SELECT "user", item, rating FROM state WHERE NOT favorite'),
    "numbered_items": with_(["inter"], "SELECT item, row_number() OVER (ORDER BY md5(item::VARCHAR), item) - 1 AS item_index FROM (SELECT DISTINCT item FROM inter)"),
    "query_item_cosine": with_(["qc"], "SELECT query_id, item, round(cos, 6) AS cos FROM qc"),
    "dense_neighbours": with_(["dcos"], "SELECT query_id, vec_id, round(cos, 6) AS cos, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM dcos) WHERE rank <= 10"),
    "factor_dot_scores": with_(["cell", "emb"], """SELECT c."user", c.item, round(coalesce(list_inner_product(u.e, v.e), 0.0), 6) AS factor_score
        FROM cell c LEFT JOIN emb u ON u.vec_id = c."user" LEFT JOIN emb v ON v.vec_id = c.item"""),
    "reviews_per_item": with_(["lab"], """SELECT item, review_id, rating, spoiler_tag, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY spoiler_tag, rating DESC, review_id) AS rank
        FROM lab WHERE label = 1) WHERE rank <= 3"""),
    "own_feedback": with_(["state"], f"""SELECT r."user", r.item, s.rating AS own_rating, s.review AS own_review, {stars('s.rating')} AS own_stars
        FROM (SELECT DISTINCT "user", 'src' || ("user" % 25) AS item FROM state) r LEFT JOIN state s ON s."user" = r."user" AND s.item = r.item"""),
    "class_counts": with_(["rev"], """SELECT count(*) FILTER (WHERE rating >= 7) AS n_pos, count(*) FILTER (WHERE rating <= 4) AS n_neg,
        round(count(*) FILTER (WHERE rating >= 7) / greatest(count(*) FILTER (WHERE rating <= 4), 1), 6) AS ratio FROM rev"""),
    "user_item_cells": with_(["cell"], "SELECT * FROM cell"),
    "active_user_cells": with_(["inter"], """SELECT "user", item, sum(rating) AS r FROM inter WHERE "user" IN (SELECT "user" FROM inter GROUP BY "user" HAVING count(*) >= 20) GROUP BY ALL"""),
    "term_frequencies": with_(["st"], "SELECT * FROM st"),
    "fitted_vocabulary": with_(["vocab"], "SELECT term, term_id, df, ctf, round(idf, 6) AS idf FROM vocab"),
    "capped_vocabulary": with_(["st"], """SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, ctf, round(ln(((SELECT count(*) FROM tr) + 1) / (df + 1)) + 1, 6) AS idf
        FROM (SELECT * FROM st WHERE df >= 3 AND df <= 0.9 * (SELECT count(*) FROM tr) ORDER BY ctf DESC, term LIMIT 1500)"""),
    "item_profile_terms": with_(["it"], "SELECT item, term_id, round(weight, 6) AS weight FROM it"),
    "item_profiles": with_(["inorm"], "SELECT item, n_terms::INTEGER AS n_terms, round(norm, 6) AS norm FROM inorm"),
    "item_full_texts": with_(["pr"], f"""SELECT item, part, count(*) AS n_texts, md5(string_agg(clean_text, ' ' ORDER BY h, review_id)) AS text_md5 FROM
        (SELECT *, {h(42, 'review_id')} AS h, CAST(floor(CAST('0x' || substring({h(42, 'review_id')}, 1, 8) AS BIGINT) / 4294967296.0 * ceil(n_item / 1000.0)) AS INTEGER) AS part FROM pr) GROUP BY item, part"""),
    "account_taste": with_(["taste"], 'SELECT "user", count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM taste GROUP BY "user"'),
    "mean_embeddings": with_(["emb"], "SELECT label AS set_id, (i - 1)::INTEGER AS term_id, round(avg(v), 6) AS weight FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM emb) GROUP BY label, i"),
    "scaled_balances": f"SELECT c_custkey, round({scaled('c_acctbal', 'c_nationkey')}, 6) AS scaled FROM customer",
    "confusion_matrix": with_(["cm"], "SELECT * FROM cm"),
    "classification_summary": with_(["pcf"], "SELECT round(sum(tp) / sum(support), 6) AS accuracy, " + ", ".join(
        f"round(sum({m} * support) / sum(support), 6) AS {m}_weighted, round(avg({m}), 6) AS {m}_macro" for m in ("precision", "recall", "f1")) + " FROM pcf"),
    "classification_per_class": with_(["pcf"], "SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pcf"),
    "ranking_auc": f"SELECT round(auc, 6) AS roc_auc FROM ({auc('orders', chr(40) + 'o_orderpriority IN (' + q('1-URGENT') + ', ' + q('2-HIGH') + '))', 'o_totalprice')})",
    "ranking_auc_macro": with_(["pred"], "SELECT round(avg(auc), 6) AS roc_auc FROM (" + " UNION ALL ".join(auc("pred", f"(label = {c})", f"s{c}") for c in (0, 1, 2)) + ")"),
    "score_mean_std": "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders",
    "account_summary": with_(["state"], 'SELECT "user", count(*) FILTER (WHERE favorite) AS n_favorites, count(rating) AS n_ratings, round(avg(rating), 6) AS mean_rating, count(*) FILTER (WHERE review <> \'\') AS n_reviews FROM state GROUP BY "user"'),
    "nested_account_state": with_(["state"], """SELECT "user", 0 AS part, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE favorite), '') AS favorites,
        coalesce(string_agg(item || '=' || rating, ',' ORDER BY item) FILTER (WHERE rating IS NOT NULL), '') AS ratings, count(review)::INTEGER AS n_reviews FROM state GROUP BY "user" """),
    "dashboard": with_(["inorm", "inter", "pcf"], 'SELECT (SELECT count(*) FROM inorm) AS n_items, (SELECT count(DISTINCT "user") FROM inter) AS n_users, round(sum(tp) / sum(support), 6) AS accuracy, NULL::DOUBLE AS explained_variance FROM pcf'),
    "query_candidates": with_(["qpool"], "SELECT query_id, item, round(cos, 6) AS cos FROM qpool"),
    "seed_candidates": with_(["spool"], "SELECT query_id, item, round(cos, 6) AS cos FROM spool"),
    "user_top_items": with_(["inorm", "rev"], 'SELECT "user", item, round(cos, 6) AS cos, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY cos DESC, item) AS rank FROM ua) WHERE rank <= 10', {
        "uv": 'SELECT "user", term_id, sum(weight) AS weight FROM rev JOIN it USING (item) GROUP BY "user", term_id',
        "un": 'SELECT "user", sqrt(sum(weight * weight)) AS norm FROM uv GROUP BY "user"',
        "uc": 'SELECT uv."user", it.item, round(sum(uv.weight * it.weight) / any_value(un.norm) / any_value(inorm.norm), 9) AS cos FROM uv JOIN it USING (term_id) JOIN un ON un."user" = uv."user" JOIN inorm ON inorm.item = it.item GROUP BY uv."user", it.item',
        "ua": 'SELECT un."user", inorm.item, coalesce(uc.cos, 0) AS cos FROM un CROSS JOIN inorm LEFT JOIN uc ON uc."user" = un."user" AND uc.item = inorm.item',
    }),
    "account_keywords": with_(["fav", "inorm"], 'SELECT "user", term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY "user" ORDER BY w DESC, term)::INTEGER AS rank FROM kk WHERE rn <= CASE WHEN gram THEN 4 ELSE 4 END', {
        "km": f"""SELECT "user", term, sum(it.weight) / any_value(n) AS weight, contains(term, ' ') AS gram
            FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS n FROM fav WHERE item IN (SELECT item FROM inorm)) f JOIN it USING (item) JOIN vocab USING (term_id)
            WHERE contains(term, ' ') OR term NOT IN {GENERIC} GROUP BY "user", term""",
        "kk": 'SELECT *, round(weight, 9) AS w, row_number() OVER (PARTITION BY "user", gram ORDER BY round(weight, 9) DESC, term) AS rn FROM km',
    }),
    "explained_results": with_(["qpool"], f"""SELECT query_id, item, term, round(w, 6) AS weight, rank::INTEGER AS rank FROM (
        SELECT query_id, item, term, least(q.weight, i.weight) AS w, row_number() OVER (PARTITION BY query_id, item ORDER BY round(least(q.weight, i.weight), 9) DESC, term) AS rank
        FROM qpool JOIN qt q USING (query_id) JOIN it i USING (item, term_id) JOIN vocab USING (term_id) WHERE term NOT IN {GENERIC}) WHERE rank <= 4"""),
    "sorted_catalogue": with_(["inter"], 'SELECT DISTINCT "user" AS item FROM inter ORDER BY item LIMIT 50'),
    "never_liked_items": with_(["cell"], "SELECT DISTINCT item FROM cell WHERE item NOT IN (SELECT item FROM cell WHERE r >= 11)"),
    "all_title_keys": with_(["tkeys"], "SELECT title_key FROM tkeys"),
    "combined_parts": """SELECT doc_id AS id, md5(text) AS text_md5, source, NULL::VARCHAR AS role FROM documents
        UNION ALL SELECT conv_id * 100 + turn, md5(text), NULL, role FROM conversations""",
    "balanced_reviews": with_(["rev"], "SELECT review_id, rating FROM b", {
        "n": "SELECT count(*) FILTER (WHERE rating >= 7) AS p, count(*) FILTER (WHERE rating <= 4) AS n FROM rev",
        "b": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rating >= 7 ORDER BY {h(42, 'review_id')}, review_id) AS r FROM rev WHERE rating >= 7 OR rating <= 4)
            WHERE rating <= 4 OR r <= floor((SELECT n FROM n) * 1.5)""",
    }),
    "capped_balanced_reviews": with_(["rev"], f"SELECT review_id, rating FROM b ORDER BY {h('cap-42', 'review_id')}, review_id LIMIT 120", {
        "n": "SELECT count(*) FILTER (WHERE rating >= 7) AS p, count(*) FILTER (WHERE rating <= 4) AS n FROM rev",
        "b": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rating >= 7 ORDER BY {h(42, 'review_id')}, review_id) AS r FROM rev WHERE rating >= 7 OR rating <= 4)
            WHERE rating <= 4 OR r <= floor((SELECT n FROM n) * 1.5)""",
    }),
    "oversampled_rows": with_(["rev"], """SELECT review_id, label, unnest(range(0, CASE WHEN label = 1 THEN 1 ELSE 1 + extra // n + CASE WHEN r <= extra % n THEN 1 ELSE 0 END END))::INTEGER AS copy FROM l, n""", {
        "l": f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(42, 'review_id')}, review_id) AS r FROM (SELECT review_id, CASE WHEN rating >= 7 THEN 1 ELSE 0 END AS label FROM rev WHERE rating >= 7 OR rating <= 4)",
        "n": "SELECT n, CASE WHEN p / greatest(n, 1) > 1.5 THEN CAST(floor(p * (1 / 1.5::DOUBLE)) AS BIGINT) - n ELSE 0 END AS extra FROM (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM l)",
    }),
    "train_test_split": with_(["rev"], "SELECT review_id, l.label, r <= n - train AS is_test FROM l JOIN c USING (label)",
        split("(SELECT review_id, CASE WHEN rating >= 7 THEN 1 WHEN rating <= 4 THEN 0 ELSE -1 END AS label FROM rev)")),
    "validation_folds": f"""SELECT o_orderkey, label, (CASE WHEN r > floor(n * 1 / 3) THEN 1 ELSE 0 END + CASE WHEN r > floor(n * 2 / 3) THEN 1 ELSE 0 END)::INTEGER AS fold FROM
        (SELECT o_orderkey, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {h(42, 'o_orderkey')}, o_orderkey) AS r
         FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders))""",
    "sampled_users": with_(["inter"], f"""SELECT "user", n_rows FROM (SELECT "user", count(*) AS n_rows FROM inter GROUP BY "user" HAVING count(*) >= 3) ORDER BY {h(42, '"user"')} LIMIT 200"""),
    "text_tokens": f"SELECT conv_id, turn, array_to_string({words('text', True)}, '|') AS tokens FROM conversations",
    "text_ngrams": with_(["qtf"], "SELECT query_id, term, tf FROM qtf"),
    "review_tfidf": with_(["dt"], "SELECT review_id, term_id, round(weight, 6) AS weight FROM dt"),
    "query_tfidf": with_(["qt"], "SELECT query_id, term_id, round(weight, 6) AS weight FROM qt"),
    "recommended_by_query": with_(["qpool"], f"SELECT query_id, item, is_pers, {ROUNDED}, rank FROM ({picks('query_id, item, is_pers, cos, pers_raw, cos_norm, pers_norm, final')})",
        {**guest("qpool"), **ISIM, **three_picks("bl", "isim", "item", "final")}),
    "recommended_by_query_plain": with_(["qpool"], f"SELECT query_id, item, is_pers, {ROUNDED}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM bl) WHERE rank <= 5", guest("qpool")),
    "recommended_personally": with_(["qpool", "tc"], f"SELECT query_id, item, is_pers, {ROUNDED}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM bl) WHERE rank <= 5", {
        "e": "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings",
        "ps": """SELECT p.*, CASE WHEN p.query_id % 3 = 1 THEN p.query_id IN (SELECT "user" FROM fav) WHEN p.query_id % 3 = 2 THEN u.vec_id IS NOT NULL ELSE false END AS is_pers,
            CASE WHEN p.query_id % 3 = 1 THEN coalesce(tc.cos, 0) WHEN p.query_id % 3 = 2 THEN coalesce(list_inner_product(u.e, v.e), 0) ELSE 0 END AS pers_raw
            FROM qpool p LEFT JOIN tc ON tc."user" = p.query_id AND tc.item = p.item LEFT JOIN e u ON u.vec_id = p.query_id LEFT JOIN e v ON 'src' || v.vec_id = p.item""",
        "sc": f"SELECT *, {scaled('cos', 'query_id')} AS cos_norm, {scaled('pers_raw', 'query_id')} AS pers_norm FROM ps",
        "bl": "SELECT *, round(CASE WHEN is_pers THEN 0.6 * cos_norm + 0.4 * pers_norm ELSE cos_norm END, 9) AS final FROM sc",
    }),
    "recommended_by_seeds": with_(["spool"], f"SELECT query_id, item, is_pers, {ROUNDED}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM bl) WHERE rank <= 5", guest("spool")),
    "account_home_feed": with_(["spool"], f"SELECT query_id, item, is_pers, {ROUNDED}, rank FROM ({picks('query_id, item, is_pers, cos, pers_raw, cos_norm, pers_norm, final')})", {
        "sc": f"SELECT *, true AS is_pers, cos AS pers_raw, {scaled('cos', 'query_id')} AS cos_norm, {scaled('cos', 'query_id')} AS pers_norm FROM spool",
        "bl": "SELECT *, round(0.6 * cos_norm + 0.4 * pers_norm, 9) AS final FROM sc", **ISIM, **three_picks("bl", "isim", "item", "final"),
    }),
    "diversified_neighbours": with_(["dcos"], f"SELECT query_id, vec_id, round(cos, 6) AS cos, rank FROM ({picks('query_id, vec_id, cos')})", {
        "dpool": "SELECT * FROM dcos QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) <= 50",
        "dsim": "SELECT query_id AS a, vec_id AS b, cos AS s FROM dcos", **three_picks("dpool", "dsim", "vec_id", "cos"),
    }),
    "user_ranking_metrics": with_(["cell"], 'SELECT "user", round(precision_5, 6) AS precision_5, round(ndcg_5, 6) AS ndcg_5, round(precision_10, 6) AS precision_10, round(ndcg_10, 6) AS ndcg_10 FROM um', user_metrics()),
    "mean_ranking_metrics": with_(["cell"], "SELECT round(avg(precision_5), 6) AS precision_5, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(precision_10), 6) AS precision_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM um", user_metrics()),
    "list_diversity": with_(["dcos"], """SELECT query_id % 40 AS list_id, round(1 - sum(cos) / count(*), 6) AS ild FROM dcos WHERE query_id < vec_id AND query_id % 40 = vec_id % 40 GROUP BY query_id % 40"""),
    "offline_evaluation": offline(),
    "offline_evaluation_sampled": offline("LIMIT 30"),
    "offline_evaluation_holdout": offline("", 0.3),
    "prepared_reviews": prepared(False),
    "prepared_reviews_published_order": prepared(True),
    "assembled_results": with_(["qpool", "state"], f"""SELECT r.query_id, r.item, rank::INTEGER AS rank, round(final * 100, 1) AS percent, least(round(final * 100, 1), 100.0) AS bar_width,
        'https://www.youtube.com/results?search_query=' || replace(url_encode(r.item || ' official trailer'), '%20', '+') AS trailer_link,
        'https://www.imdb.com/find?q=' || replace(url_encode(r.item), '%20', '+') || '&s=tt' AS title_link,
        s.rating AS own_rating, {stars('s.rating')} AS own_stars, explanation, shown
        FROM rr r LEFT JOIN state s ON s."user" = r.query_id AND s.item = r.item LEFT JOIN ex ON ex.query_id = r.query_id AND ex.item = r.item
        LEFT JOIN sh ON sh.query_id = r.query_id AND sh.item = r.item""", {
        **guest("qpool"),
        "rr": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM bl QUALIFY rank <= 3",
        "ex": f"""SELECT query_id, item, string_agg(term, '|' ORDER BY k) AS explanation FROM (SELECT query_id, item, term,
            row_number() OVER (PARTITION BY query_id, item ORDER BY round(least(q.weight, i.weight), 9) DESC, term) AS k
            FROM rr JOIN qt q USING (query_id) JOIN it i USING (item, term_id) JOIN vocab USING (term_id) WHERE term NOT IN {GENERIC}) WHERE k <= 4 GROUP BY query_id, item""",
        "cr": f"""SELECT item, row_number() OVER (PARTITION BY item ORDER BY spoiler_tag, rating DESC, review_id) AS place, "user", {stars('rating')} AS stars FROM lab WHERE label = 1 QUALIFY place <= 3""",
        "sh": f"""SELECT query_id, item, string_agg(place || ':' || "user" || ':' || stars, '|' ORDER BY place) AS shown FROM
            (SELECT query_id, rr.item, place, "user", stars FROM rr JOIN cr ON cr.item = rr.item
             UNION ALL SELECT query_id, rr.item, 0, query_id, {stars('s.rating')} FROM rr JOIN state s ON s."user" = query_id AND s.item = rr.item WHERE s.rating IS NOT NULL) GROUP BY query_id, item""",
    }),
    "folded_feedback": with_(["state"], 'SELECT "user", item, favorite, rating, review FROM state'),
    "streamed_feedback": with_(["state"], 'SELECT "user", item, favorite, rating, review FROM state'),
    "starred_ratings": f"SELECT p_partkey, {stars('p_size % 11')} AS stars FROM part",
}
