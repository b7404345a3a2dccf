"""DuckDB SQL with the same rows as ``queries``. Queries without an entry have no exact SQL form."""

from __future__ import annotations

from likeness.functions.text import CANONICAL_UNITS, TOKEN, UNITS
from likeness.queries import EXPAND, FUSION, JUDGE, RADIUS, K


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _tokens(title: str, canonical: bool = False) -> str:
    """Tokens of an SQL text expression: units follow the number before them."""
    units = _list(dict.fromkeys((*UNITS, *(s for v in CANONICAL_UNITS.values() for s in v))) if canonical else UNITS)
    raw = f"list_transform(regexp_extract_all(lower(coalesce({title}, '')), '{TOKEN}'), lambda t: replace(t, ',', '.'))"
    glue = f"coalesce(r[i] IN ({units}) AND regexp_full_match(replace(r[i - 1], '.', ''), '[0-9]+'), false)"
    nxt = glue.replace("r[i]", "r[i + 1]").replace("r[i - 1]", "r[i]")
    pick = f"CASE WHEN i > 1 AND {glue} THEN NULL ELSE r[i] || CASE WHEN i < len(r) AND {nxt} THEN r[i + 1] ELSE '' END END"
    glued = f"(SELECT list(x ORDER BY i) FROM (SELECT i, {pick} AS x FROM (SELECT {raw} AS r) , LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)) WHERE x IS NOT NULL)"
    if not canonical:
        return f"coalesce({glued}, [])"
    form = "t"
    for (name, factor), spellings in CANONICAL_UNITS.items():
        number, unit = "regexp_extract(t, '^([0-9]+(?:\\.[0-9]+)?)([a-z]+)$', 1)", "regexp_extract(t, '^([0-9]+(?:\\.[0-9]+)?)([a-z]+)$', 2)"
        value = f"round(TRY_CAST({number} AS DOUBLE) * {factor}, 3)"
        shown = f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"
        form = f"CASE WHEN {unit} IN ({_list(spellings)}) THEN {shown} || '{name}' ELSE {form} END"
    return f"list_transform(coalesce({glued}, []), lambda t: {form})"


TITLES = "SELECT p_partkey AS id, concat_ws(' ', p_brand, p_name, CAST(p_size AS VARCHAR), 'ml') AS title FROM part"
VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS e, CAST(label AS BIGINT) AS label FROM embeddings"
LISTINGS = f"SELECT id, title, e, label FROM ({TITLES}) JOIN ({VECTORS}) USING (id)"
DOCUMENTS = "SELECT doc_id AS id, text AS title FROM documents"
ITEMS = "SELECT item_id AS id, text AS title FROM benchmark"


def _topk(source: str, k: int, tie: str = "") -> str:
    """Rounded scores, ranked; ``source`` has query_id, cand_id, score and what the tie-break names."""
    tie = f"{tie}, " if tie else ""
    return (
        f"SELECT query_id, cand_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, cand_id, score, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}cand_id) AS rank "
        f"FROM (SELECT * REPLACE (round(score, 9) AS score) FROM ({source}))) WHERE rank <= {k}"
    )


def _bm25(corpus: str, queries: str, p: str = "b", canonical: bool = False, k1: float = 1.2, b: float = 0.75) -> list[str]:
    """CTEs: {p}_tf, {p}_stats, {p}_post, {p}_self, {p}_raw."""
    weight = f"idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"
    return [
        f"{p}_corpus AS ({corpus})", f"{p}_queries AS ({queries})",
        f"{p}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_tokens('title', canonical)}) AS term FROM {p}_corpus) GROUP BY ALL)",
        f"{p}_qf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_tokens('title', canonical)}) AS term FROM {p}_queries) GROUP BY ALL)",
        f"{p}_const AS (SELECT (SELECT count(*) FROM {p}_corpus) AS n, greatest(1e-9, (SELECT sum(tf) FROM {p}_tf)::DOUBLE / (SELECT count(*) FROM {p}_corpus)) AS avgdl)",
        f"{p}_stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {p}_tf, {p}_const GROUP BY term)",
        f"{p}_post AS (SELECT id, term, tf, dl, {weight} AS w FROM {p}_tf JOIN (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM {p}_tf GROUP BY id) USING (id) JOIN {p}_stats USING (term), {p}_const)",
        f"{p}_known AS (SELECT id, term, tf, idf FROM {p}_qf JOIN {p}_stats USING (term))",
        f"{p}_self AS (SELECT id AS query_id, sum({weight}) AS self_score FROM {p}_known JOIN (SELECT id, sum(tf) AS dl FROM {p}_known GROUP BY id) USING (id), {p}_const GROUP BY id)",
        f"{p}_raw AS (SELECT q.id AS query_id, c.id AS cand_id, sum(c.w) AS raw FROM {p}_qf q JOIN {p}_post c USING (term) GROUP BY ALL)",
        f"{p}_scored AS (SELECT query_id, cand_id, least(1.0, CASE WHEN self_score > 0 THEN raw / self_score ELSE 0 END) AS score FROM {p}_raw JOIN {p}_self USING (query_id) WHERE raw > 0)",
    ]


def _with(parts: list[str], query: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + query


def _cosine(rows: str, k: int, p: str = "d") -> list[str]:
    pairs = f"SELECT q.id AS query_id, c.id AS cand_id, list_inner_product(q.e, c.e) AS score FROM {p}_rows q, {p}_rows c"
    return [f"{p}_rows AS ({rows})", f"{p}_top AS (SELECT * REPLACE (least(score, 1.0) AS score) FROM ({_topk(pairs, k)}))"]


def _voted(rows: str, p: str = "v") -> list[str]:
    """CTEs ending in {p}_new (id, e): vectors after voting."""
    return [
        *_cosine(rows, EXPAND, p),
        f"{p}_raw AS (SELECT q.id AS query_id, c.id AS cand_id, round(list_inner_product(q.e, c.e), 9) AS score FROM {p}_rows q, {p}_rows c)",
        f"{p}_near AS (SELECT r.query_id AS id, r.cand_id, power(greatest(r.score, 0), 3.0) AS w FROM {p}_raw r JOIN {p}_top t USING (query_id, cand_id))",
        f"{p}_sum AS (SELECT n.id, i.i AS pos, sum(n.w * c.e[i.i]) AS x FROM {p}_near n JOIN {p}_rows c ON c.id = n.cand_id, (SELECT unnest(range(1, 65)) AS i) i GROUP BY ALL)",
        f"{p}_norm AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM {p}_sum GROUP BY id)",
        f"{p}_new AS (SELECT id, list(x / norm ORDER BY pos) AS e FROM {p}_sum JOIN {p}_norm USING (id) GROUP BY id)",
    ]


_SIGNS = "list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN (q.e[i] > 0) <> (c.e[i] > 0) THEN 1 ELSE 0 END), 'sum')"


def _hits(rows: str, p: str = "h") -> list[str]:
    return [f"{p}_rows AS ({rows})", f"{p}_hits AS (SELECT * FROM (SELECT q.id AS query_id, c.id AS cand_id, CAST({_SIGNS} AS INTEGER) AS dist FROM {p}_rows q, {p}_rows c) WHERE dist <= {RADIUS})"]


def _boost(base: str, k: int) -> str:
    merged = (
        f"SELECT query_id, cand_id, CASE WHEN h.dist IS NULL THEN b.score ELSE 1.0 END AS score, b.rank AS base_rank "
        f"FROM ({base}) b FULL JOIN h_hits h USING (query_id, cand_id)"
    )
    return _topk(merged, k, "base_rank ASC NULLS LAST")


def _features(a: str, b: str) -> str:
    return (
        f"SELECT query_id, cand_id, coalesce(a.score, 0) AS m0_score, coalesce(1.0 / a.rank, 0) AS m0_inv_rank, coalesce(b.score, 0) AS m1_score, "
        f"coalesce(1.0 / b.rank, 0) AS m1_inv_rank, CASE WHEN a.rank IS NULL THEN 1000000 + b.rank ELSE a.rank END AS at_ "
        f"FROM {a} a FULL JOIN {b} b USING (query_id, cand_id)"
    )


def _learned(features: str, k: int) -> str:
    (w0, w1, w2, w3), c = FUSION
    score = f"1.0 / (1.0 + exp(-(m0_score * {w0} + m0_inv_rank * {w1} + m1_score * {w2} + m1_inv_rank * {w3} + {c})))"
    return _topk(f"SELECT query_id, cand_id, at_, {score} AS score FROM ({features})", k, "at_")


_B_TOP = f"b_top AS ({_topk('SELECT * FROM b_scored', K + 1)})"
_MEMBERS = [*_bm25(LISTINGS, LISTINGS), _B_TOP, *_cosine(LISTINGS, K + 1)]
_FEATURES = f"f AS ({_features('b_top', 'd_top')})"


def _first(rows: str, k: int) -> str:
    return f"SELECT query_id, cand_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, cand_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, cand_id) AS rank FROM ({rows})) WHERE rank <= {k}"


def _matches(found: str, rows: str) -> list[str]:
    return [
        f"own AS ({rows})", f"found AS ({found})",
        "m AS (SELECT f.*, q.label = c.label AS is_match FROM found f JOIN own q ON q.id = f.query_id JOIN own c ON c.id = f.cand_id)",
        "truth AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) AS truth FROM own)",
    ]


_LISTS = [*_cosine(VECTORS, K + 1), *_matches(_first("SELECT * FROM d_top WHERE query_id <> cand_id", K), VECTORS)]


def _recall(k: int) -> str:
    return (
        f"SELECT avg(coalesce(hits, 0) / least({k}, truth - 1)) AS recall FROM truth LEFT JOIN "
        f"(SELECT query_id, count(*) AS hits FROM m WHERE is_match AND rank <= {k} GROUP BY query_id) USING (query_id) WHERE truth > 1"
    )


_MRR = "SELECT avg(coalesce(1.0 / first, 0)) AS mrr FROM truth LEFT JOIN (SELECT query_id, min(rank) AS first FROM m WHERE is_match GROUP BY query_id) USING (query_id) WHERE truth > 1"


def _f1(threshold: str, min_matches: int = 0, relative: float = 0.0, more: str = "", by: str = "") -> str:
    """Rows (query_id, f1), for each row of ``more``, whose columns ``by`` the threshold may name."""
    rule = f"score >= {threshold}"
    rule += f" OR (best >= {threshold} AND score >= {relative} * best)" if relative else ""
    rule += f" OR rank <= {min_matches}" if min_matches else ""
    best = "(SELECT m.*, max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) AS best FROM m)"
    sums = f"SELECT {by}query_id, count(*) FILTER ({rule}) AS n, count(*) FILTER (({rule}) AND is_match) AS tp FROM {best}{more} GROUP BY ALL"
    every = f"SELECT {by}query_id, truth FROM truth{more}"
    return f"SELECT {by}query_id, 2.0 * (1 + coalesce(tp, 0)) / (1 + coalesce(n, 0) + truth) AS f1 FROM ({every}) LEFT JOIN ({sums}) USING ({by}query_id)"


def _curve(min_matches: int = 0, relative: float = 0.0) -> str:
    rows = _f1("threshold", min_matches, relative, ", (SELECT round(i / 100.0, 2)::DOUBLE AS threshold FROM range(101) r(i))", "threshold, ")
    return f"SELECT threshold, avg(f1) AS mean_f1 FROM ({rows}) GROUP BY threshold"


def _tuned(curve: str) -> str:
    return f"SELECT threshold, f1 FROM (SELECT threshold, round(mean_f1, 12) AS f1 FROM ({curve})) ORDER BY f1 DESC, threshold DESC LIMIT 1"


def _split(rows: str) -> list[str]:
    return [
        f"s_rows AS ({rows})",
        "s_groups AS (SELECT label, row_number() OVER (ORDER BY md5('42|' || CAST(label AS VARCHAR)), label) AS nth, count(*) OVER () AS total FROM (SELECT DISTINCT label FROM s_rows))",
        "s_cut AS (SELECT label, nth, round_even(total * 0.7, 0) AS a, round_even(total * 0.1, 0) AS b FROM s_groups)",
        "s AS (SELECT id, label, CASE WHEN nth <= a THEN 'train' WHEN nth <= a + b THEN 'val' ELSE 'test' END AS split FROM s_rows JOIN s_cut USING (label))",
    ]


PRODUCTS = "SELECT p_partkey AS id, p_name AS label FROM part"
_FOLD = "CASE WHEN substr(md5('fold0|' || CAST(label AS VARCHAR)), 1, 1) < '8' THEN 'A' ELSE 'B' END"
_NEGATIVES = "neg AS (" + _first("SELECT query_id, cand_id, score, rank FROM m WHERE NOT is_match AND rank <= 20", 5) + ")"
_EXPORT = f"x AS (SELECT m.query_id, m.cand_id, m.score AS base_score, m.is_match AS same, {_FOLD} AS fold FROM m JOIN own ON own.id = m.query_id WHERE rank <= 20)"

_TRIPLETS = [
    "t AS (SELECT id, label, md5('0|' || CAST(id AS VARCHAR)) AS turn FROM own)",
    "ring AS (SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS positive, count(*) OVER (PARTITION BY label) AS n FROM t WINDOW w AS (PARTITION BY label ORDER BY turn, id))",
    "mined AS (SELECT query_id AS id, arg_min(cand_id, md5('1|' || CAST(query_id AS VARCHAR) || '|' || CAST(cand_id AS VARCHAR))) AS mined FROM neg GROUP BY query_id)",
    "two AS (SELECT label, min(turn) AS turn, arg_min(id, turn) AS id FROM t GROUP BY label ORDER BY 2 LIMIT 2)",
    """spare AS (SELECT id, coalesce(CASE WHEN lead(label, 1) OVER w <> label THEN lead(id, 1) OVER w END, CASE WHEN lag(label, 1) OVER w <> label THEN lag(id, 1) OVER w END,
      CASE WHEN lead(label, 2) OVER w <> label THEN lead(id, 2) OVER w END, CASE WHEN lag(label, 2) OVER w <> label THEN lag(id, 2) OVER w END,
      (SELECT arg_min(two.id, two.turn) FROM two WHERE two.label <> t.label)) AS spare
      FROM t WINDOW w AS (PARTITION BY substr(turn, 1, 1) ORDER BY turn, id))""",
]

(_J0, _J1), _JC = JUDGE
_OVERLAP = [
    f"toks AS (SELECT id, list_distinct({_tokens('title')}) AS t FROM ({LISTINGS}))",
    "base AS (" + _first("SELECT * FROM d_top", 21) + ")",
    f"judged AS (SELECT b.query_id, b.cand_id, b.rank AS base_rank, CASE WHEN b.query_id = b.cand_id THEN 1.0 ELSE 1.0 / (1.0 + exp(-(b.score * {_J0} + "
    f"(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t)))) * {_J1} + {_JC}))) END AS score "
    "FROM base b JOIN toks q ON q.id = b.query_id JOIN toks c ON c.id = b.cand_id)",
]

_FINAL = [
    *_bm25(LISTINGS, LISTINGS, canonical=True), _B_TOP, *_voted(LISTINGS), *_cosine("SELECT id, e FROM v_new", K + 1), _FEATURES, *_hits(LISTINGS),
    f"boosted AS ({_boost(_learned('SELECT * FROM f', K + 1), K + 1)})",
]
_DROPPED = _first("SELECT * FROM boosted WHERE query_id <> cand_id", K)

_WORDS = [
    *_bm25(TITLES, TITLES, canonical=True),
    "words AS (SELECT term, ln(1 + n::DOUBLE / df) AS w, list_transform(range(0, 4), lambda i: CAST(('0x' || substr(md5(term), CAST(1 + 2 * i AS INTEGER), 2)) AS INTEGER) - 127.5) AS v FROM b_stats, b_const)",
    "unit AS (SELECT term, w, list_transform(v, lambda x: x / sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))) AS v FROM words)",
    "sums AS (SELECT id, i, sum(tf * w * v[i]) AS x FROM b_tf JOIN unit USING (term), (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL)",
    "vecs AS (SELECT id, list(x ORDER BY i) AS v FROM sums GROUP BY id)",
    "lens AS (SELECT id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS norm FROM vecs)",
]

ORACLES: dict[str, str] = {
    "tokenize": f"SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT id, {_tokens('title')} AS t FROM ({DOCUMENTS}))",
    "canonical_units": f"SELECT id AS p_partkey, array_to_string({_tokens('title', True)}, ' ') AS tokens FROM ({TITLES})",
    "term_stats": _with(_bm25(DOCUMENTS, ITEMS), "SELECT term, df, cf, round(idf, 9) AS idf FROM b_stats"),
    "bm25_postings": _with(_bm25(DOCUMENTS, ITEMS), "SELECT id AS doc_id, term, tf, dl, round(w, 9) AS w FROM b_post"),
    "bm25_topk": _with([*_bm25(LISTINGS, LISTINGS), _B_TOP], "SELECT * FROM b_top"),
    "bm25_self_score": _with(_bm25(TITLES, TITLES), "SELECT query_id, round(self_score, 9) AS self_score FROM b_self"),
    "bm25_benchmark_vs_documents": _with(_bm25(DOCUMENTS, ITEMS), _topk("SELECT * FROM b_scored", K)),
    "ivf_recall": "SELECT CAST(count(*) * least(51, count(*)) AS BIGINT) AS neighbours, true AS nine_in_ten FROM embeddings",
    "cosine_topk": _with(_cosine(VECTORS, K + 1), "SELECT * FROM d_top"),
    "neighbour_votes": _with(_voted(VECTORS), "SELECT id, round(e[1], 9) AS x0, round(e[64], 9) AS x63 FROM v_new"),
    "knn_expand": _with([*_voted(VECTORS), *_cosine("SELECT id, e FROM v_new", K + 1)], "SELECT * FROM d_top"),
    "hamming_pairs": _with(_hits(VECTORS), "SELECT * FROM h_hits"),
    "phash_boost": _with([*_bm25(LISTINGS, LISTINGS), _B_TOP, *_hits(LISTINGS)], _boost("SELECT * FROM b_top", K + 1)),
    "fusion_features": _with([*_MEMBERS, _FEATURES], "SELECT query_id, cand_id, m0_score, round(m0_inv_rank, 9) AS m0_inv_rank, m1_score, round(m1_inv_rank, 9) AS m1_inv_rank FROM f"),
    "rrf_fusion": _with(
        [*_MEMBERS, _FEATURES],
        _topk(f"SELECT query_id, cand_id, at_, ({' + '.join(f'CASE WHEN m{n}_inv_rank > 0 THEN 1.0 / (60 + 1.0 / m{n}_inv_rank) ELSE 0 END' for n in (0, 1))}) / (2 / 61.0) AS score FROM f", K + 1, "at_"),
    ),
    "learned_fusion": _with([*_MEMBERS, _FEATURES], _learned("SELECT * FROM f", K + 1)),
    "rerank_by_overlap": _with([*_cosine(LISTINGS, K + 1), *_OVERLAP], _topk("SELECT * FROM judged", K + 1, "base_rank")),
    "drop_self_topk": _with(_LISTS, "SELECT * FROM found"),
    "match_flags": _with(_LISTS, "SELECT query_id, cand_id, score, rank, is_match FROM m"),
    "group_sizes": _with(_LISTS, "SELECT query_id, truth FROM truth"),
    "recall": _with(_LISTS, " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(recall, 9) AS recall FROM ({_recall(k)})" for k in (10, 50))),
    "mrr": _with(_LISTS, f"SELECT round(mrr, 9) AS mrr FROM ({_MRR})"),
    "f1_threshold": _with(_LISTS, f"SELECT query_id, round(f1, 9) AS f1 FROM ({_f1('0.4')})"),
    "f1_min_matches": _with(_LISTS, f"SELECT query_id, round(f1, 9) AS f1 FROM ({_f1('0.4', 1)})"),
    "f1_relative": _with(_LISTS, f"SELECT query_id, round(f1, 9) AS f1 FROM ({_f1('0.4', 1, 0.8)})"),
    "floor_f1": _with(_LISTS, "SELECT query_id, round(2.0 / (1 + truth), 9) AS f1 FROM truth"),
    "f1_curve": _with(_LISTS, f"SELECT threshold, round(mean_f1, 9) AS mean_f1 FROM ({_curve(1, 0.8)})"),
    "tune_threshold": _with(_LISTS, f"SELECT threshold, round(f1, 9) AS f1 FROM ({_tuned(_curve())})"),
    "precision_at_recall": _with(
        _LISTS,
        "SELECT round(max(tp / n), 9) AS precision FROM (SELECT sum(CASE WHEN is_match THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS n FROM m "
        "WINDOW w AS (ORDER BY score DESC, query_id, rank ROWS UNBOUNDED PRECEDING)), (SELECT sum(truth - 1) AS pos FROM truth) WHERE tp >= 0.05 * pos",
    ),
    "latency_percentiles": "SELECT round(quantile_cont(s, 0.5) * 1000, 9) AS p50_ms, round(quantile_cont(s, 0.95) * 1000, 9) AS p95_ms, "
    "round(avg(s) * 1000 * 0.1 / 3600, 9) AS usd_per_1k_queries FROM (SELECT value / 1000 AS s FROM events)",
    "pool_union": _with(_split("SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings"), "SELECT id, label, split = 'val' AS is_query FROM s WHERE split IN ('val', 'train')"),
    "group_split": _with(_split(PRODUCTS), "SELECT id, split FROM s"),
    "split_counts": _with(_split(PRODUCTS), "SELECT split, count(*) AS listings, count(DISTINCT label) AS groups FROM s GROUP BY split"),
    "fold_assign": f"SELECT id, {_FOLD} AS fold FROM ({PRODUCTS})",
    "coverage_antijoin": "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)",
    "hard_negatives": _with([*_LISTS, _NEGATIVES], "SELECT query_id, cand_id, rank FROM neg"),
    "pair_export": _with([*_LISTS, _EXPORT], "SELECT * FROM x"),
    "captured_share": _with([*_LISTS, _EXPORT], "SELECT round(count(*) FILTER (same) / (SELECT sum(truth - 1) FROM truth), 9) AS share FROM x"),
    "triplets": _with(
        [*_LISTS, _NEGATIVES, *_TRIPLETS],
        "SELECT id AS anchor, positive, coalesce(mined, spare) AS negative FROM ring LEFT JOIN mined USING (id) JOIN spare USING (id) WHERE n > 1 AND coalesce(mined, spare) IS NOT NULL",
    ),
    "title_jaccard_pairs": _with(
        [f"k AS MATERIALIZED (SELECT id, list_distinct({_tokens('title')}) AS t FROM ({TITLES}))"],
        "SELECT a, b, round(j, 9) AS jaccard FROM (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS j "
        "FROM k x JOIN k y ON x.id < y.id) WHERE j >= 0.8 - 1e-12",
    ),
    "title_vectors": _with(_WORDS, f"SELECT id, {', '.join(f'round(v[{i + 1}] / norm, 9) AS x{i}' for i in range(4))} FROM lens"),
    "final_candidates": _with(_FINAL, _DROPPED),
    "final_pipeline": _with(
        [*_FINAL, *_matches(_DROPPED, LISTINGS)],
        f"SELECT threshold, round(f1, 9) AS f1, round(recall, 9) AS recall_10, round(mrr, 9) AS mrr FROM ({_tuned(_curve(1, 0.8))}), ({_recall(10)}), ({_MRR})",
    ),
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
