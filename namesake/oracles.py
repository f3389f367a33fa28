"""The same queries as plain SQL over the driver tables."""

from __future__ import annotations

from namesake.queries import DOC_FEATURES, DOC_RULES, DOC_STEP, EDGE_THRESHOLD, MAX_YEAR_DIFF, PAIR_RULES
from namesake.standin import GRAM_DIMS, SPEC

# The sampling queries.
SAMPLE_SEED, SAMPLE_SIZE, BOOTSTRAP_MEMBERS = 42, 100, 5

MATCH = ", ".join(SPEC.match_cols)
W, K = SPEC.window, SPEC.top_k

# Record table, as in standin.records.
_CELLS = """p_partkey, 'say "' || p_name || '", size ' || p_size || ',' AS note,
  CASE WHEN p_size % 7 > 0 THEN p_brand END AS brand, p_retailprice"""

REC = """rec AS (
  SELECT p_partkey AS record_id, 'e' || p_size AS edition, p_size AS seq, 1800.0::DOUBLE + p_size AS year,
    split_part(p_name, ' ', 1) AS xing, split_part(p_name, ' ', 2) AS ming, '?' AS zihao, p_type AS diqu,
    p_brand AS jigou_1, CASE WHEN p_type = 'SMALL' THEN '? ?' ELSE p_type END AS jigou_2, lower(p_type) AS guanzhi_1,
    p_brand AS ren_xian, p_type AS ren_sheng,
    CASE WHEN p_brand LIKE '%5' THEN '?' ELSE split_part(p_name, ' ', 1) END AS chushen_1
  FROM part)"""

_DIMS = ", ".join(
    f"((ascii(g[1]) * {j + 3} + ascii(g[2]) * {2 * j * j + 7} + ascii(g[3]) * {5 * j + 1}) % 97) / 97.0 - 0.5" for j in range(GRAM_DIMS)
)


def _mean(source: str, key: str, out: str) -> str:
    """Element-wise mean of ``vec`` per key, as a list."""
    return f"""{out} AS (
  SELECT {key}, list(x ORDER BY j) AS vec FROM (
    SELECT {key}, j, avg(vec[j]) AS x FROM {source}, range(1, {GRAM_DIMS + 1}) t(j) GROUP BY {key}, j) GROUP BY {key})"""


def _unit(source: str, key: str, out: str) -> str:
    return f"""{out} AS (
  SELECT {key}, CASE WHEN list_dot_product(vec, vec) > 0
    THEN list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) ELSE vec END AS vec FROM {source})"""


# Distinct values, their symbols and vectors, and those of the block values.
VECTORS = f"""{REC},
vals AS (SELECT DISTINCT value FROM (
  SELECT unnest([{MATCH}]) AS value FROM rec UNION ALL SELECT ming[1] FROM rec UNION ALL SELECT ming[2] FROM rec) WHERE value <> ''),
sym AS (SELECT DISTINCT unnest(string_split(value, '')) AS s FROM vals),
gram AS (SELECT s, unnest(CASE WHEN s IN ('?', '？', ' ') THEN ['*?*'] ELSE ['*' || s || s, s || s || '*'] END) AS g FROM sym),
gramvec AS (SELECT s, [{_DIMS}]::DOUBLE[] AS vec FROM gram),
{_mean("gramvec", "s", "symvec")},
valsym AS (SELECT value, unnest(string_split(value, '')) AS s FROM vals),
valrow AS (SELECT value, vec FROM valsym JOIN symvec USING (s)),
{_mean("valrow", "value", "valmean")},
{_unit("valmean", "value", "valvec")},
blocks AS (SELECT DISTINCT xing || chr(1) || ming AS bkey, xing || ming AS letters FROM rec),
blockrow AS (SELECT bkey, vec FROM (SELECT bkey, unnest(string_split(letters, '')) AS s FROM blocks) JOIN symvec USING (s)),
{_mean("blockrow", "bkey", "blockmean")},
{_unit("blockmean", "bkey", "blockvec")},
blockset AS (SELECT bkey, list_distinct(string_split(letters, '')) AS toks FROM blocks),
blocksim AS (
  SELECT a.bkey AS lb, b.bkey AS rb, round(list_dot_product(va.vec, vb.vec), 9) AS shape,
    round(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))), 9) AS phon
  FROM blockset a, blockset b, blockvec va, blockvec vb WHERE va.bkey = a.bkey AND vb.bkey = b.bkey)"""


def _candidates(window: int, k: int, left: str = "TRUE", buffered: bool = True) -> str:
    """CTEs down to ``cand(left_id, right_id, by_shape, by_phon)``."""
    key = "xing || chr(1) || ming || chr(1) || ren_xian || chr(1) || ren_sheng"
    limit = f"n <= {2 * k} AND" if buffered else ""
    if not buffered:
        guaranteed_first = "AND l.gkey <> r.gkey"
    else:
        guaranteed_first = ""
    return f"""{VECTORS},
keyed AS (SELECT record_id, seq, xing || chr(1) || ming AS bkey, {key} AS gkey FROM rec),
band AS (SELECT l.record_id AS left_id, r.record_id AS right_id, l.gkey AS lg, r.gkey AS rg, shape, phon
  FROM keyed l JOIN keyed r ON r.seq >= l.seq AND r.seq < l.seq + {window} {guaranteed_first}
  JOIN blocksim ON lb = l.bkey AND rb = r.bkey WHERE {left}),
shape1 AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY shape DESC, right_id) AS n FROM band),
shape2 AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY n) AS m FROM shape1 WHERE {limit} lg <> rg),
phon1 AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY phon DESC, right_id) AS n FROM band WHERE phon > 0),
phon2 AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY n) AS m FROM phon1 WHERE {limit} lg <> rg),
cand AS (SELECT left_id, right_id, bool_or(s) AS by_shape, bool_or(NOT s) AS by_phon FROM (
  SELECT left_id, right_id, TRUE AS s FROM shape2 WHERE m <= {k} UNION ALL
  SELECT left_id, right_id, FALSE AS s FROM phon2 WHERE m <= {k}) WHERE left_id <> right_id GROUP BY 1, 2)"""


_MISSING = "regexp_matches({0}, '^(\\?\\s?)+$')"


def _attribute(c: str) -> tuple[str, str]:
    gone = f"{_MISSING.format('l.' + c)} OR {_MISSING.format('r.' + c)}"
    lookup = f"(SELECT {{0}} FROM valsim v WHERE v.a = l.{c} AND v.b = r.{c})"
    return tuple(f"CASE WHEN {gone} THEN -1.0 ELSE {lookup.format(x)} END AS {c}_{n}" for x, n in (("shape", "stroke"), ("phon", "pinyin")))


def _symbol(i: int) -> str:
    a, b = f"l.ming[{i}]", f"r.ming[{i}]"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' OR {a} IN ('?', ' ') OR {b} IN ('?', ' ') THEN -1.0 "
        f"ELSE (SELECT shape FROM valsim v WHERE v.a = {a} AND v.b = {b}) END AS ming_sim{i}"
    )


def _features(window: int = W, k: int = K, left: str = "TRUE") -> str:
    cols = [_attribute(c) for c in SPEC.match_cols]
    exprs = [a for a, _ in cols] + [b for _, b in cols]
    exprs += ["abs(len(l.ming) - len(r.ming)) AS ming_cnt_diff", _symbol(1), _symbol(2), "(l.year = r.year)::INT AS same_year"]
    rounded = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in SPEC.feature_names)
    return f"""{_candidates(window, k, left)},
valset AS (SELECT value, list_distinct(string_split(value, '')) AS toks FROM vals),
valsim AS (SELECT x.value AS a, y.value AS b, list_dot_product(vx.vec, vy.vec) AS shape,
    len(list_intersect(x.toks, y.toks)) / len(list_distinct(list_concat(x.toks, y.toks))) AS phon
  FROM valset x, valset y, valvec vx, valvec vy WHERE vx.value = x.value AND vy.value = y.value),
raw AS (SELECT left_id, right_id, {", ".join(exprs)} FROM cand JOIN rec l ON l.record_id = left_id JOIN rec r ON r.record_id = right_id),
feat AS (SELECT left_id, right_id, {rounded} FROM raw)"""


_PROB = " + ".join(f"({c} >= {bound})::INT" for c, bound in PAIR_RULES)
EDGES = f"""{_features()},
scored AS (SELECT left_id, right_id, round(({_PROB}) / {len(PAIR_RULES)}, 6) AS prob FROM feat),
edges AS (SELECT least(left_id, right_id) AS src, greatest(left_id, right_id) AS dst, max(prob) AS weight
  FROM scored WHERE prob >= {EDGE_THRESHOLD} GROUP BY 1, 2)"""

# All exact-key pairs by name and brand, earlier row first.
PAIRS = f"""exact AS (SELECT l.record_id AS a, r.record_id AS b FROM rec l JOIN rec r
  ON l.xing = r.xing AND l.ming = r.ming AND l.ren_xian = r.ren_xian
  AND (l.seq < r.seq OR (l.seq = r.seq AND l.record_id < r.record_id)) AND r.year - l.year < {MAX_YEAR_DIFF})"""


def _reach(arcs: str) -> str:
    """CTEs from ``both(a, b)`` to ``comp(record_id, cluster)``."""
    return f"""both_ways AS ({arcs}),
reach AS (SELECT record_id AS id, record_id AS root FROM rec
  UNION SELECT w.b, reach.root FROM reach JOIN both_ways w ON w.a = reach.id),
comp AS (SELECT id AS record_id, min(root) AS cluster FROM reach GROUP BY id)"""


_EXACT_ARCS = "SELECT a, b FROM exact UNION SELECT b, a FROM exact"
_ALL_ARCS = _EXACT_ARCS + " UNION SELECT src, dst FROM edges UNION SELECT dst, src FROM edges"
GRAPH = f"{EDGES}, {PAIRS}, {_reach(_ALL_ARCS)}"

_DOC_PREDICTED = "(" + " + ".join(f"(n_chars >= {DOC_STEP * (b + 1)})::INT" for b in range(DOC_RULES)) + f") / {DOC_RULES}"
_ENTROPY = "-(p * ln(p + 1e-12) + (1 - p) * ln(1 - p + 1e-12))"
_WORDS = "list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')"
_SIZES = f"""WITH {REC}, sizes AS (
  SELECT xing || ' ' || ming AS name, count(*) AS n_records, count(DISTINCT edition) AS n_editions FROM rec GROUP BY 1)"""


def _stats(source: str, column: str, where: str = "") -> str:
    return f"""count(*) AS n_clusters, round(avg({column}), 6) AS mean_size, round(stddev_pop({column}), 6) AS std_size,
  round(median({column}), 6) AS median_size FROM {source} {where}"""


_IDS = f"""{REC}, {PAIRS}, {_reach(_EXACT_ARCS)},
first_row AS (SELECT cluster, min((seq, c.record_id)) AS o FROM comp c JOIN rec USING (record_id) GROUP BY cluster),
numbered AS (SELECT cluster, row_number() OVER (ORDER BY o) - 1 AS number FROM first_row)"""

_STROKES = "CASE WHEN ascii({0}) % 11 <> 0 THEN substr('ABCDE', ascii({0}) % 5 + 1, 1) || substr('VWXYZ', ascii({0}) % 7 % 5 + 1, 1) ELSE '?' END"
_STD = "CASE WHEN s IN ('a', 'i', 'o', 'u') THEN 'e' ELSE s END"


def _gram_text(seq: str) -> str:
    """All trigrams of a text, joined by a bar."""
    return f"array_to_string(list_transform(range(1, len({seq}) - 1), lambda i: substr({seq}, i, 3)), '|')"


ORACLES: dict[str, str] = {
    "edition_dimension": f"""WITH {REC}, d AS (SELECT edition, min(record_id) AS first_record, count(*) AS n_records FROM rec GROUP BY 1)
      SELECT edition, first_record, n_records, row_number() OVER (ORDER BY first_record) - 1 AS edition_seq FROM d""",
    "stride_sample_editions": f"""WITH {REC}, d AS (SELECT edition, min(record_id) AS f FROM rec GROUP BY 1),
      o AS (SELECT edition, row_number() OVER (ORDER BY f) - 1 AS edition_seq, count(*) OVER () AS total FROM d)
      SELECT edition, edition_seq FROM o WHERE edition_seq % greatest(1, total // 10) = 0""",
    "edition_record_counts": f"WITH {REC} SELECT edition, count(*) AS n_records FROM rec GROUP BY 1",
    "fractional_year": "SELECT o_orderkey, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4 AS frac_year FROM orders",
    "edition_key": """SELECT o_orderkey, nullif(o_orderstatus, 'P') || year(o_orderdate)::VARCHAR || quarter(o_orderdate)::VARCHAR AS edition
      FROM orders""",
    "missing_mask": f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '? ?' WHEN lang = 'de' THEN '??' WHEN source = 'src1' THEN NULL
        WHEN source = 'src2' THEN '?' ELSE text END AS v FROM documents)
      SELECT doc_id, v IS NULL OR {_MISSING.format('v')} AS missing, coalesce(v, '?') AS filled, nullif(v, '?') AS unfilled,
        NOT (v IS NULL OR {_MISSING.format('v')}) AS has_key FROM d""",
    "ngrams_padded": f"WITH p AS (SELECT p_partkey, '*' || p_name || '*' AS t FROM part) SELECT p_partkey, {_gram_text('t')} AS grams FROM p",
    "bracket_compose": """SELECT p_partkey, array_to_string(list_concat(string_split(split_part(p_name, ' ', 1), ''),
        [lower(p_type) || p_brand], string_split(split_part(p_name, ' ', 2), '')), '|') AS symbols FROM part""",
    "variant_translate": f"""WITH {REC} SELECT record_id, translate(xing, 'aiou', 'eeee') AS xing_standard,
        translate(ming, 'aiou', 'eeee') AS ming_standard FROM rec""",
    "shape_and_phonetic_tokens": f"""WITH {REC}, v AS (SELECT DISTINCT unnest([xing, ming, ren_xian]) AS value FROM rec),
      p AS (SELECT value, i, value[i] AS s FROM v, range(1, 40) t(i) WHERE i <= len(value)),
      u AS (SELECT value, i, '*' || {_STROKES.format('s')} || {_STROKES.format('(' + _STD + ')')} || '*' AS t,
        CASE WHEN ascii(s) >= 97 THEN 's' || (ascii(s) % 6) ELSE s END AS phon FROM p)
      SELECT value, string_agg({_gram_text('t')}, '/' ORDER BY i) AS shape, string_agg(phon, '|' ORDER BY i) AS phon FROM u GROUP BY value""",
    "record_tokens": f"""WITH {REC}, v AS (SELECT DISTINCT unnest([xing, ming]) AS value FROM rec),
      p AS (SELECT value, i, value[i] AS s FROM v, range(1, 40) t(i) WHERE i <= len(value)),
      u AS (SELECT value, string_agg('*' || s || s || '|' || s || s || '*', '|' ORDER BY i) AS stroke, string_agg(s, '|' ORDER BY i) AS pinyin
        FROM p GROUP BY value)
      SELECT record_id, a.stroke AS xing_stroke, a.pinyin AS xing_pinyin, b.stroke AS ming_stroke, b.pinyin AS ming_pinyin
      FROM rec JOIN u a ON a.value = xing JOIN u b ON b.value = ming""",
    "gram_embedding": f"""WITH {VECTORS} SELECT value, (j - 1)::INT AS dim, round(vec[j], 6) AS x FROM valvec, range(1, {GRAM_DIMS + 1}) t(j)""",
    "cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
        FROM embeddings),
      p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS sim FROM e a, e b),
      r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rank FROM p)
      SELECT left_id, right_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10""",
    "jaccard_topk": f"""WITH {VECTORS}, b AS (SELECT record_id, seq, xing || chr(1) || ming AS bkey FROM rec),
      p AS (SELECT l.record_id AS left_id, r.record_id AS right_id, phon AS sim FROM b l JOIN b r ON r.seq >= l.seq AND r.seq < l.seq + {W}
        JOIN blocksim ON lb = l.bkey AND rb = r.bkey WHERE phon > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rank FROM p)
      SELECT left_id, right_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= {K}""",
    "token_jaccard_documents": f"""WITH i AS (SELECT item_id, list_distinct({_WORDS}) AS t FROM benchmark),
      d AS (SELECT doc_id, list_distinct({_WORDS}) AS t FROM documents),
      x AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM i), y AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d),
      p AS (SELECT item_id, doc_id, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 9) AS sim
        FROM x JOIN y USING (w) GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM p)
      SELECT item_id, doc_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5""",
    "band_window_counts": f"""WITH {REC}, c AS (SELECT ren_xian, seq, count(*) AS n FROM rec GROUP BY 1, 2)
      SELECT ren_xian, l.seq AS l_seq, l.n, (SELECT count(*) FROM rec r WHERE r.ren_xian = l.ren_xian AND r.seq >= l.seq
        AND r.seq < l.seq + {W}) AS n_window FROM c l""",
    "guaranteed_pair_counts": f"""WITH {REC} SELECT l.record_id, count(r.record_id) AS n_guaranteed FROM rec l LEFT JOIN rec r
        ON l.xing = r.xing AND l.ming = r.ming AND l.ren_xian = r.ren_xian AND r.seq >= l.seq AND r.seq < l.seq + {W}
        AND r.record_id <> l.record_id GROUP BY 1""",
    "blocked_candidates": f"WITH {_candidates(W, K)} SELECT left_id, right_id, by_shape, by_phon FROM cand",
    "blocked_candidates_unbuffered": f"WITH {_candidates(W, K, buffered=False)} SELECT left_id, right_id, by_shape, by_phon FROM cand",
    "pair_features": f"WITH {_features()} SELECT * FROM feat",
    "training_pool": f"""WITH {_features(3, 10, "l.seq % greatest(1, (SELECT count(DISTINCT seq) FROM rec) // 10) = 0")}
      SELECT row_number() OVER (ORDER BY left_id, right_id) - 1 AS pair_id, left_id, right_id, ming_stroke, ming_sim1 FROM feat""",
    "vote_mean_entropy": f"""WITH d AS (SELECT doc_id, {_DOC_PREDICTED} AS p FROM documents)
      SELECT doc_id, quality, round(p, 6) AS predicted, round({_ENTROPY}, 6) AS uncertainty FROM d JOIN labels USING (doc_id)""",
    "uncertain_topk_antijoin": f"""WITH d AS (SELECT doc_id, {_DOC_PREDICTED} AS p FROM documents ANTI JOIN labels USING (doc_id))
      SELECT doc_id, round(p, 6) AS predicted, round({_ENTROPY}, 6) AS uncertainty FROM d ORDER BY round({_ENTROPY}, 9) DESC, doc_id LIMIT 100""",
    "random_sample": f"SELECT doc_id, lang FROM documents ORDER BY md5('{SAMPLE_SEED}_' || doc_id), doc_id LIMIT {SAMPLE_SIZE}",
    "bootstrap_draws": f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS slot, count(*) OVER () AS total FROM labels),
      d AS (SELECT id % {BOOTSTRAP_MEMBERS} AS member, ('0x' || substr(md5('{SAMPLE_SEED}_' || id), 1, 8))::BIGINT % (SELECT count(*) FROM labels) AS slot
        FROM range((SELECT count(*) FROM labels) * {BOOTSTRAP_MEMBERS}) t(id))
      SELECT member, doc_id, count(*) AS times FROM d JOIN n USING (slot) GROUP BY 1, 2""",
    "class_weights": """SELECT count_if(quality = 1)::BIGINT AS n_pos, count_if(quality <> 1)::BIGINT AS n_neg,
      round(count_if(quality <> 1) / greatest(count_if(quality = 1), 1), 6) AS pos_weight FROM labels""",
    "standardise_features": f"""WITH f AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, len({_WORDS})::DOUBLE AS n_words,
        (len(text) - len(replace(text, chr(10), '')))::DOUBLE AS n_lines, len(list_distinct({_WORDS}))::DOUBLE AS n_distinct,
        (len(text) - len(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE AS n_digits FROM documents)
      SELECT doc_id, {", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}" for c in DOC_FEATURES)} FROM f""",
    "label_cell_text": f"""WITH {REC}, n AS (SELECT *, lead(record_id) OVER (PARTITION BY xing, ming, ren_xian ORDER BY seq, record_id) AS nxt FROM rec)
      SELECT l.xing || l.ming || ' |' || chr(10) || ' ' || r.xing || r.ming AS name,
        l.jigou_1 || ' ' || l.jigou_2 || ' |' || chr(10) || ' ' || r.jigou_1 || ' ' || r.jigou_2 AS jigou,
        l.ren_xian || ' ' || l.ren_sheng || ' |' || chr(10) || ' ' || r.ren_xian || ' ' || r.ren_sheng AS "rensheng&xian",
        l.year::VARCHAR || ' |' || chr(10) || ' ' || r.year::VARCHAR AS year, l.record_id AS pair_id
      FROM n l JOIN rec r ON r.record_id = l.nxt""",
    "label_round_trip": f"""WITH {REC}, n AS (SELECT *, lead(record_id) OVER (PARTITION BY xing, ming, ren_xian ORDER BY seq, record_id) AS nxt FROM rec)
      SELECT l.record_id AS pair_id, (l.record_id % 2)::INTEGER AS label, l.xing || l.ming || ' |' || chr(10) || ' ' || r.xing || r.ming AS name,
        l.year::VARCHAR || ' |' || chr(10) || ' ' || r.year::VARCHAR AS year
      FROM n l JOIN rec r ON r.record_id = l.nxt""",
    "edition_files": f"WITH {REC} SELECT record_id, edition, seq::BIGINT AS edition_seq, year, xing FROM rec WHERE seq >= 10 AND seq < 13",
    "csv_round_trip": f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, {_CELLS} FROM part",
    "one_edition": f"WITH {REC} SELECT record_id, edition, seq::BIGINT AS edition_seq, xing, ming FROM rec WHERE edition = 'e7'",
    "all_editions": """WITH r AS (SELECT p_partkey AS record_id, 'e' || p_size AS edition, coalesce(nullif(p_type, 'SMALL'), '?') AS kind, p_brand AS maker
        FROM part WHERE p_brand <> 'Brand#11'),
      d AS (SELECT edition, row_number() OVER (ORDER BY min(record_id)) - 1 AS edition_seq FROM r GROUP BY edition)
      SELECT record_id, edition, kind, maker, edition_seq FROM r JOIN d USING (edition)""",
    "dictionary_files": """WITH c AS (SELECT DISTINCT unnest(string_split(p_name || p_brand, '')) AS char FROM part), n AS (SELECT char, ascii(char) AS k FROM c WHERE char <> ' ')
      SELECT 'strokes' AS kind, char, substr('ABCDE', k % 5 + 1, 1) || substr('VWXYZ', k % 7 % 5 + 1, 1) AS value FROM n WHERE k % 11 <> 0
      UNION ALL SELECT 'standard', char, 'e' FROM n WHERE char IN ('a', 'i', 'o', 'u')
      UNION ALL SELECT 'syllable', char, 's' || (k % 6) FROM n WHERE k >= 97""",
    "rank_features": """WITH g AS (SELECT p_partkey, p_size % 12 - 1 AS l, floor(p_retailprice)::BIGINT % 11 - 1 AS r FROM part),
      t AS (SELECT p_partkey, CASE WHEN l = 0 THEN 10 ELSE l END AS l, CASE WHEN r = 0 THEN 10 ELSE r END AS r FROM g)
      SELECT p_partkey, (CASE WHEN l <> -1 AND r <> -1 THEN abs(r - l) ELSE -1 END)::DOUBLE AS rank_diff, least(l, r)::DOUBLE AS rank_min FROM t""",
    "candidate_files": f"""WITH {_features()} SELECT left_id, right_id, seq::BIGINT AS left_seq, ming_stroke
      FROM feat JOIN rec ON record_id = left_id""",
    "labelled_pairs": f"""WITH {_features()}, p AS (SELECT left_id * 100000 + right_id AS pair_id, ming_stroke, same_year FROM feat)
      SELECT pair_id, ming_stroke, same_year::BIGINT AS same_year, (pair_id % 2)::INTEGER AS label FROM p WHERE pair_id % 3 > 0""",
    "json_values": f"SELECT {_CELLS} FROM part",
    "edge_dedup": f"WITH {EDGES} SELECT src, dst, weight FROM edges",
    "guaranteed_edges_year_bound": f"""WITH {REC}, {PAIRS} SELECT record_id, count(x.id) AS n_matches FROM rec
      LEFT JOIN (SELECT a AS id FROM exact UNION ALL SELECT b FROM exact) x ON x.id = record_id GROUP BY 1""",
    "connected_components": f"WITH RECURSIVE {GRAPH} SELECT record_id, cluster FROM comp",
    "community_moves": f"""WITH RECURSIVE {EDGES}, {_reach("SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges")},
      ties AS (SELECT src AS record_id, weight FROM edges UNION ALL SELECT dst, weight FROM edges)
      SELECT record_id, cluster, round(coalesce(sum(weight), 0), 6) AS degree, false AS gains
      FROM comp LEFT JOIN ties USING (record_id) GROUP BY record_id, cluster""",
    "induced_edges": f"""WITH {EDGES} SELECT src, dst, s.edition || '_' || s.ren_xian AS grp FROM edges
      JOIN rec s ON s.record_id = src JOIN rec d ON d.record_id = dst WHERE s.edition = d.edition AND s.ren_xian = d.ren_xian""",
    "strange_ratio": f"""WITH RECURSIVE {GRAPH},
      nxt AS (SELECT cluster, c.record_id AS a, lead(c.record_id) OVER (PARTITION BY cluster ORDER BY seq, c.record_id) AS b
        FROM comp c JOIN rec USING (record_id)),
      mis AS (SELECT cluster, b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM both_ways w WHERE w.a = nxt.a AND w.b = nxt.b) AS missing FROM nxt)
      SELECT cluster, count(*) AS n_rows, sum(missing::INT)::BIGINT AS breaks, round(sum(missing::INT) / count(*), 6) AS ratio,
        (sum(missing::INT) <= {SPEC.max_breaks} AND sum(missing::INT) / count(*) <= {SPEC.max_break_ratio}) OR count(*) <= {SPEC.min_size} AS leaf
      FROM mis GROUP BY 1""",
    "person_ids_dense": f"""WITH RECURSIVE {_IDS} SELECT record_id, cluster AS new_person_id, number AS new_person_id_2
      FROM comp JOIN numbered USING (cluster)""",
    "cluster_size_stats": f"""{_SIZES} SELECT 'n_records' AS counted, {_stats("sizes", "n_records")}
      UNION ALL SELECT 'n_editions', {_stats("sizes", "n_editions")}""",
    "cluster_size_histogram": f"""{_SIZES} SELECT least(n_records // 3, 19) AS bin, count(*) AS n_clusters FROM sizes
      WHERE n_records BETWEEN 0 AND 60 GROUP BY 1""",
    "resolve_entities": f"""WITH RECURSIVE {_IDS}, s AS (SELECT cluster, count(*) AS n_records, count(DISTINCT edition) AS n_editions
        FROM comp JOIN rec USING (record_id) GROUP BY 1)
      """ + " UNION ALL ".join(
        f"SELECT '{i}' AS ids, '{c}' AS counted, {_stats('s', c)}" for i in ("new_person_id", "new_person_id_2") for c in ("n_records", "n_editions")
    ),
}
