"""The same queries in SQL, for checking against another engine."""

from __future__ import annotations

KS = (1, 10, 100)

# Views of the embeddings: double vectors, int8 codes, f16 and bf16 roundings.
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _codes(vector: str, overflow: str = "saturate") -> str:
    code = "floor((x * 127::FLOAT)::DOUBLE + 0.5)"
    if overflow == "saturate":
        return f"list_transform({vector}, lambda x: least(127, greatest(-128, {code}))::DOUBLE)"
    return f"list_transform({vector}, lambda x: (((({code} + 128)::BIGINT % 256) + 256) % 256 - 128)::DOUBLE)"


def _rounded(bits: int, lowest: int) -> str:
    step = f"power(2.0::DOUBLE, greatest(floor(log2(abs(x::DOUBLE))), {lowest}) - {bits})"
    return (
        "list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0::DOUBLE "
        f"ELSE round_even(x::DOUBLE / {step}, 0) * {step} END)"
    )


_VECTORS = {
    "f32": "embedding::DOUBLE[]",
    "f16": _rounded(10, -14),
    "bf16": _rounded(7, -126),
    "i8": _codes("embedding"),
}
_DISTANCES = {
    "l2": "power(list_distance(q.v, n.v), 2)",
    "ip": "1 - list_inner_product(q.v, n.v)",
    "cos": "1 - list_inner_product(q.v, n.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(n.v, n.v)))",
}


def _knn(
    name: str,
    k: int,
    metric: str = "l2",
    precision: str = "f32",
    exclude_self: bool = False,
    where: str = "TRUE",
    partition: str = "q.vec_id",
    extra: str = "",
) -> str:
    """CTEs ``<name>`` with the top-K of every query."""
    distinct = "q.vec_id <> n.vec_id" if exclude_self else "TRUE"
    return f"""{name}_v AS (SELECT vec_id, label, {_VECTORS[precision]} AS v FROM embeddings),
    {name}_d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, n.label, {_DISTANCES[metric]} AS distance
      FROM {name}_v q, {name}_v n WHERE {distinct} AND {where}),
    {name} AS (SELECT *{extra}, CAST(row_number() OVER (PARTITION BY {partition.replace('q.vec_id', 'query_id')}
      ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM {name}_d QUALIFY rank <= {k})"""


def _topk(k: int = 10, **options) -> str:
    return f"WITH {_knn('h', k, **options)} SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM h"


def _elements(source: str, key: str, column: str, kind: str = "DOUBLE") -> str:
    value = "round(value::DOUBLE, 6)" if kind == "DOUBLE" else f"value::{kind}"
    return f"""SELECT {key}, CAST(i - 1 AS INTEGER) AS i, {value} AS value FROM (
      SELECT {key}, unnest({column}) AS value, generate_subscripts({column}, 1) AS i FROM {source})"""


_MEANS = """m AS (SELECT label, list(x ORDER BY i) AS v FROM (
      SELECT label, i, avg(x::DOUBLE) AS x FROM (
        SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
      GROUP BY label, i) GROUP BY label)"""
_CENTROIDS = f"{_MEANS}, c AS (SELECT label AS cell_id, v::FLOAT[]::DOUBLE[] AS v FROM m)"


def _nearest(metric: str = "l2") -> str:
    """Ranked cells of every vector."""
    measure = {"l2": "list_distance(e.v, c.v)", "ip": "-list_inner_product(e.v, c.v)",
        "cos": "-list_cosine_similarity(e.v, c.v)"}[metric]
    return f"""SELECT e.vec_id, c.cell_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {measure}, c.cell_id) AS pos
      FROM e, c"""


_CELLS = f"{_E}, {_CENTROIDS}, a AS (SELECT vec_id, cell_id FROM ({_nearest()}) WHERE pos = 1)"


def _ivf(name: str, k: int, nprobe: int, metric: str = "l2", exclude_self: bool = False) -> str:
    """Top-K inside the probed cells; needs the CTEs of ``_CELLS``."""
    distinct = "q.vec_id <> n.vec_id" if exclude_self else "TRUE"
    return f"""{name}_p AS (SELECT vec_id, cell_id FROM ({_nearest(metric)}) WHERE pos <= {nprobe}),
    {name}_d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, {_DISTANCES[metric]} AS distance
      FROM {name}_p p JOIN e q ON p.vec_id = q.vec_id JOIN a ON a.cell_id = p.cell_id JOIN e n ON n.vec_id = a.vec_id
      WHERE {distinct}),
    {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank
      FROM {name}_d QUALIFY rank <= {k})"""


def _lsh(k: int, tables: int, bits: int, flips: int) -> str:
    """Top-K among the rows in a probed bucket: signs of projections, and the weakest bits of each table flipped."""
    mixed = "(t * 1000003 + b * 10007 + (d - 1) * 101 + 12345) % 2147483647"
    steps = ", ".join(f"m{i} AS (SELECT t, b, d, (x * x % 2147483647 + x * 48271 + 11) % 2147483647 AS x FROM m{i - 1})" for i in (1, 2, 3))
    return f"""WITH {_E}, m0 AS (SELECT t, b, d, ({mixed})::BIGINT AS x FROM range({tables}) a(t), range({bits}) f(b),
        range(1, (SELECT max(len(v)) FROM e) + 1) g(d)), {steps},
    planes AS (SELECT t, b, list(CASE WHEN x // 65536 % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE ORDER BY d) AS v FROM m3 GROUP BY t, b),
    p AS (SELECT vec_id, t, b, list_inner_product(e.v, planes.v) AS x FROM e, planes),
    own AS (SELECT vec_id, t, sum(CASE WHEN x > 0 THEN 1 << b ELSE 0 END)::BIGINT AS code FROM p GROUP BY vec_id, t),
    weak AS (SELECT vec_id, t, b, row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(x), b) AS place FROM p),
    probes AS (FROM own UNION ALL SELECT vec_id, t, xor(code, (1 << b)::BIGINT) FROM own JOIN weak USING (vec_id, t) WHERE place <= {flips}),
    met AS (SELECT DISTINCT q.vec_id AS query_id, n.vec_id AS neighbor_id FROM probes q JOIN own n USING (t, code)),
    h AS (SELECT query_id, neighbor_id, {_DISTANCES['l2']} AS distance FROM met JOIN e q ON q.vec_id = query_id JOIN e n ON n.vec_id = neighbor_id)
    SELECT query_id, neighbor_id, round(distance, 6) AS distance,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM h QUALIFY rank <= {k}"""


def _scores(name: str, hits: str, truth: str, ks=KS, by: str = "") -> str:
    """CTE ``<name>`` with the scores of every query and K."""
    on = f"{by}, " if by else ""
    groups = f"CROSS JOIN (SELECT DISTINCT {by} FROM {hits})" if by else ""
    same = f"AND h.{by} = t.{by}" if by else ""
    values = ", ".join(f"({k})" for k in ks)
    return f"""{name}_k(k) AS (VALUES {values}),
    {name}_t AS (SELECT query_id, rank, neighbor_id{', ' + by if by else ''} FROM {truth} {groups}),
    {name}_n AS (SELECT query_id, count(*) AS n FROM {truth} GROUP BY query_id),
    {name}_s AS (SELECT {'t.' + by + ',' if by else ''} t.query_id, kk.k,
        max(CASE WHEN t.rank = 1 AND h.rank <= kk.k THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall,
        sum(CASE WHEN t.rank <= kk.k AND h.rank <= kk.k THEN 1 / log2(h.rank + 1) ELSE 0.0 END)::DOUBLE AS dcg,
        sum(CASE WHEN t.rank <= kk.k AND h.rank <= kk.k THEN 1 ELSE 0 END) AS common
      FROM {name}_t t CROSS JOIN {name}_k kk
      LEFT JOIN {hits} h ON h.query_id = t.query_id AND h.neighbor_id = t.neighbor_id {same}
      GROUP BY {'t.' + by + ',' if by else ''} t.query_id, kk.k),
    {name} AS (SELECT {on} query_id, k, recall, common::DOUBLE / k AS overlap,
        dcg / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
      FROM {name}_s JOIN {name}_n USING (query_id))"""


def _summary(scores: str, by: str = "") -> str:
    on = f"{by}, " if by else ""
    return f"""SELECT {on} k, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg,
      round(avg(overlap), 6) AS overlap, count(*) AS n_evaluated FROM {scores} GROUP BY {on} k"""


_TRUTH = _knn("t", 100, exclude_self=True)
_COARSE = _knn("h", 100, precision="i8", exclude_self=True)
_COARSE_SCORES = f"WITH {_TRUTH}, {_COARSE}, {_scores('s', 'h', 't')}"
_SWEEP = ", ".join(
    [_TRUTH]
    + [_knn(f"h_{p}", 100, precision=p, exclude_self=True) for p in _VECTORS]
    + ["h AS (" + " UNION ALL ".join(f"SELECT '{p}' AS precision, query_id, neighbor_id, rank FROM h_{p}" for p in _VECTORS) + ")"]
    + [_scores("s", "h", "t", by="precision")]
)
_BYTES = "(VALUES ('f32', 4), ('f16', 2), ('bf16', 2), ('i8', 1)) b(precision, element_bytes)"
_SIZES = "(SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dims FROM embeddings)"
_PIVOT = "SELECT precision, " + ", ".join(
    f"max(CASE WHEN k = {k} THEN {m} END) AS {m}_at_{k}" for k in KS for m in ("recall", "ndcg")
) + " FROM (SELECT precision, k, avg(recall) AS recall, avg(ndcg) AS ndcg FROM s GROUP BY precision, k) GROUP BY precision"

_EVENT_RUNS = """runs AS (SELECT user_id, count(*) AS num_vectors,
      sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS num_queries,
      sum(CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT ELSE 0 END) AS indexing_time_ms,
      sum(CASE WHEN event_type IN ('view', 'click') THEN floor(value)::BIGINT ELSE 0 END) AS search_time_ms,
      sum(CASE WHEN event_type = 'view' THEN floor(value)::BIGINT ELSE 0 END) AS pure_search_time_ms,
      sum(CASE WHEN event_type = 'click' THEN floor(value)::BIGINT ELSE 0 END) AS id_lookup_time_ms,
      sum(floor(value)::BIGINT * 1000003) AS memory_bytes
    FROM events GROUP BY user_id)"""


def _rate(amount: str, time_ms: str) -> str:
    return f"CASE WHEN {time_ms} > 0 THEN {amount} / ({time_ms} / 1000.0::DOUBLE) ELSE 0.0::DOUBLE END"


def _memory(size: str) -> str:
    mib = f"({size} / 1048576.0::DOUBLE)"
    return f"CASE WHEN {mib} >= 1024 THEN printf('%.1f GB', {mib} / 1024.0::DOUBLE) ELSE printf('%.0f MB', {mib}) END"


_WORDS = r"regexp_split_to_table(lower(text), '[ \t\n\x0B\f\r]+')"
_TERMS = f"""w AS (SELECT doc_id, term FROM (SELECT doc_id, {_WORDS} AS term FROM documents) WHERE term <> ''),
    d AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
    v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM d GROUP BY term HAVING count(*) >= 2
      ORDER BY total DESC, term LIMIT 1024),
    terms AS (SELECT term, CAST(row_number() OVER (ORDER BY total DESC, term) - 1 AS INTEGER) AS term_id, df, total,
      ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) AS idf FROM v)"""


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    for metric in ("l2", "ip", "cos"):
        sql[f"exact_knn_{metric}"] = _topk(metric=metric)
    for precision in ("i8", "f16", "bf16"):
        sql[f"precision_{precision}_topk"] = _topk(precision=precision)
    sql["shard_local_topk"] = f"""WITH {_E}, d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
        CAST(n.vec_id % 8 AS INTEGER) AS shard_id, {_DISTANCES['l2']} AS distance FROM e q, e n)
      SELECT query_id, neighbor_id, round(distance, 6) AS distance, shard_id, CAST(row_number() OVER
        (PARTITION BY query_id, shard_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10"""
    sql["sharded_search"] = sql["merge_topk"] = sql["exact_knn_blocks"] = _topk()
    sql["late_materialize"] = (
        f"WITH {_knn('h', 10)} SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank, label FROM h"
    )
    sql["rerank_i8"] = f"""WITH {_knn('h', 20, precision='i8')}, {_E}, r AS (SELECT h.query_id, h.neighbor_id,
        {_DISTANCES['l2']} AS distance FROM h JOIN e q ON q.vec_id = h.query_id JOIN e n ON n.vec_id = h.neighbor_id)
      SELECT query_id, neighbor_id, round(distance, 6) AS distance, CAST(row_number() OVER
        (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10"""
    sql["ivf_build"] = f"""WITH {_CELLS} SELECT cell_id::BIGINT AS cell_id, count(*) AS n_vectors, min(vec_id) AS min_id,
        max(vec_id) AS max_id FROM a GROUP BY cell_id"""
    hits = "SELECT query_id, neighbor_id, round(distance, 6) AS distance, rank FROM h"
    sql["ivf_search"] = f"WITH {_CELLS}, {_ivf('h', 10, 3)} {hits}"
    sql["ivf_search_blocks"] = sql["sharded_ivf_search"] = sql["ivf_search"]
    sql["ivf_search_table"] = sql["ivf_search"]
    sql["lsh_search"] = _lsh(10, 12, 6, 4)
    sql["ivf_two_level"] = _topk()
    sql["kmeans_ivf_checks"] = """SELECT nprobe, (SELECT count(*) FROM embeddings) AS n_queries, 0 AS n_worse, 0 AS n_wrong
        FROM (VALUES (1), (4), (16)) t(nprobe)"""
    sql["ivf_search_ip"] = f"WITH {_CELLS}, {_ivf('h', 10, 3, 'ip')} {hits}"
    probes = (1, 2, 4, 10)
    sweeps = ", ".join(_ivf(f"h{n}", 10, n, exclude_self=True) for n in probes)
    union = " UNION ALL ".join(f"SELECT {n} AS nprobe, query_id, neighbor_id, rank FROM h{n}" for n in probes)
    sql["nprobe_sweep"] = f"""WITH {_CELLS}, {sweeps}, h AS ({union}), {_TRUTH},
        {_scores('s', 'h', 't', (10,), 'nprobe')} {_summary('s', 'nprobe')}"""
    sql["kmeans_ivf_full_probe"] = _topk()
    sql["query_by_vector"] = f"""WITH {_E}, {_CENTROIDS}, d AS (SELECT concat('label ', q.cell_id) AS query,
        n.vec_id AS neighbor_id, {_DISTANCES['l2']} AS distance FROM c q, e n)
      SELECT query, neighbor_id, round(distance, 6) AS distance, CAST(row_number() OVER
        (PARTITION BY query ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10"""
    sql["search_observed"] = f"""WITH {_knn('h', 10)} SELECT count(*) AS n_hits, max(rank) AS max_rank,
        round(max(distance), 6) AS max_distance FROM h"""

    sql["rank_score"] = f"WITH {_knn('h', 10)} SELECT query_id, neighbor_id, round(1.0::DOUBLE / rank, 6) AS score FROM h"
    sql["map_external_ids"] = f"""WITH {_knn('h', 10)} SELECT query_id, CASE WHEN l.doc_id IS NULL THEN neighbor_id
        ELSE l.doc_id * 10 + 7 END AS neighbor_id, round(distance, 6) AS distance, rank
      FROM h LEFT JOIN labels l ON l.doc_id = h.neighbor_id"""
    sql["checked_int_ids"] = f"""WITH {_knn('h', 10)} SELECT query_id::INTEGER AS query_id,
        neighbor_id::INTEGER AS neighbor_id, rank FROM h"""
    sql["truncate_at_k"] = _topk(5)
    sql["limit_base"] = _topk(where="n.vec_id < 300")
    sql["limit_queries"] = _topk(where="q.vec_id < 50")
    sql["evaluable_queries"] = "SELECT vec_id AS query_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)"

    for name, metric in (("dist_l2sq", "l2"), ("dist_ip", "ip"), ("dist_cos", "cos")):
        sql[name] = f"""WITH {_E}, {_MEANS} SELECT q.vec_id AS row_id, round({_DISTANCES[metric]}, 6) AS distance
          FROM e q JOIN m n ON q.label = n.label"""
    stretched = "list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT)"
    for name, overflow in (("quantize_i8", "saturate"), ("quantize_i8_wrap", "wrap")):
        source = f"(SELECT vec_id AS row_id, {_codes('stretched', overflow)} AS codes FROM (SELECT vec_id, {stretched} AS stretched FROM embeddings))"
        sql[name] = _elements(source, "row_id", "codes", "INTEGER")
    codes = f"(SELECT vec_id AS row_id, {_codes('embedding')} AS codes FROM embeddings)"
    restored = f"(SELECT row_id, list_transform(codes, lambda c: (c::FLOAT / 127::FLOAT)::FLOAT) AS restored FROM {codes})"
    sql["dequantize_i8"] = _elements(restored, "row_id", "restored")
    scaled = f"(SELECT row_id, list_transform(codes, lambda c: (((c + 256) % 256) / 255.0::DOUBLE)::FLOAT) AS scaled FROM {codes})"
    sql["scale_u8"] = _elements(scaled, "row_id", "scaled")
    for precision in ("f16", "bf16"):
        source = f"(SELECT vec_id AS row_id, {_VECTORS[precision]} AS rounded FROM embeddings)"
        sql[f"round_{precision}"] = _elements(source, "row_id", "rounded")
    third = "(SELECT vec_id AS row_id, list_transform(embedding, lambda x: (x::DOUBLE / 3)::FLOAT) AS narrow FROM embeddings)"
    sql["cast_f32"] = sql["decode_f64"] = _elements(third, "row_id", "narrow")
    sql["validate_dims"] = """SELECT CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n_vectors FROM embeddings
        GROUP BY len(embedding)"""
    sql["format_memory"] = f"SELECT doc_id, {_memory('(n_chars * 100003)')} AS memory FROM documents"
    sql["path_extension"] = r"SELECT page_id, regexp_extract(url, '(\.[^./]*)$', 1) AS extension FROM pages"
    sql["storage_estimate"] = f"""SELECT n_vectors, dims, precision, element_bytes,
        (n_vectors * dims * element_bytes * 2)::BIGINT AS total_bytes FROM {_SIZES}, {_BYTES}"""

    sql["round_robin_shards"] = "SELECT vec_id AS row_id, CAST(vec_id % 8 AS INTEGER) AS shard_id FROM embeddings"
    sql["contiguous_ranges"] = """WITH n AS (SELECT count(*) AS n, count(*) // 7 AS b, count(*) % 7 AS r FROM embeddings)
      SELECT vec_id AS row_id, CAST((SELECT max(t) FROM range(7) x(t) WHERE t * b + least(t, r) <= vec_id) AS INTEGER) AS range_id
      FROM embeddings, n"""
    sql["fixed_batches"] = "SELECT vec_id AS row_id, vec_id // 128 AS batch_id FROM embeddings"
    sql["semantic_shards"] = f"""WITH {_CELLS}, p AS (SELECT vec_id, cell_id,
        (row_number() OVER (PARTITION BY cell_id ORDER BY vec_id) - 1) // 30 AS part FROM a)
      SELECT vec_id AS row_id, cell_id::BIGINT AS cell_id,
        CAST(dense_rank() OVER (ORDER BY cell_id, part) - 1 AS INTEGER) AS shard_id FROM p"""
    sql["semantic_shards_all_rows"] = f"""WITH {_E}, {_CENTROIDS}, a AS (SELECT vec_id,
          CASE WHEN vec_id % 10 IN (3, 7) THEN -1 ELSE cell_id END AS cell_id FROM ({_nearest('cos')}) WHERE pos = 1),
        p AS (SELECT vec_id, cell_id, (row_number() OVER (PARTITION BY cell_id ORDER BY vec_id) - 1) // 30 AS part FROM a)
      SELECT vec_id AS row_id, cell_id::BIGINT AS cell_id,
        CAST(dense_rank() OVER (ORDER BY cell_id, part) - 1 AS INTEGER) AS shard_id FROM p"""
    sql["shard_filter"] = _elements("(SELECT vec_id AS id, embedding FROM embeddings WHERE label = 3)", "id", "embedding")
    sql["shard_stats"] = f"""WITH {_MEANS}, n AS (SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY label)
      SELECT label::BIGINT AS shard_id, n_vectors, round(sqrt(list_inner_product(v, v)), 6) AS centroid_norm
      FROM m JOIN n USING (label)"""
    sql["distinct_shards"] = "SELECT DISTINCT label AS shard_id FROM embeddings"
    sql["map_vector_batches"] = """SELECT vec_id // 128 AS batch_id, vec_id // 128 * 128 AS start_index, count(*) AS n_vectors,
        round(sum(list_sum(embedding::DOUBLE[])), 6) AS total FROM embeddings GROUP BY vec_id // 128"""
    sql["map_byte_batches"] = f"""SELECT row_id // 128 AS batch_id, count(*) AS n_vectors,
        sum(list_sum(codes))::BIGINT AS total FROM {codes} GROUP BY row_id // 128"""

    plain = "(SELECT vec_id AS row_id, embedding FROM embeddings{})"
    sql["read_vectors"] = _elements(plain.format(""), "row_id", "embedding")
    sql["read_slice"] = _elements(plain.format(" WHERE vec_id >= 100 AND vec_id < 350"), "row_id", "embedding")
    sql["read_one_shard"] = sql["shard_filter"]
    sql["decode_f16"] = sql["round_f16"]
    sql["decode_i8"] = _elements(codes, "row_id", "codes")
    unsigned = f"(SELECT row_id, list_transform(codes, lambda c: (c + 256) % 256) AS codes FROM {codes})"
    sql["decode_u8"] = _elements(unsigned, "row_id", "codes")
    sql["vector_info"] = """SELECT 'FLOAT32' AS type, count(*) AS rows, CAST(max(len(embedding)) AS INTEGER) AS dims
        FROM embeddings"""
    sql["read_truth"] = f"WITH {_knn('h', 100)} SELECT query_id, rank, neighbor_id FROM h"
    sql["truth_with_distance"] = f"""WITH {_knn('h', 100)} SELECT query_id, rank, neighbor_id,
        round(distance::FLOAT::DOUBLE, 5) AS distance FROM h"""
    sql["read_ids"] = "SELECT vec_id AS row_id, vec_id * 10 + 7 AS external_id FROM embeddings"
    keyed = "(SELECT label::BIGINT * 1000000 + vec_id AS key, embedding FROM embeddings)"
    sql["write_shards"] = sql["write_shard_files"] = _elements(keyed, "key", "embedding")
    sql["shard_metadata"] = """SELECT label AS shard_id, concat('shard_id=', label) AS index_path, count(*) AS n_vectors,
        min(vec_id) AS min_id, max(vec_id) AS max_id FROM embeddings GROUP BY label"""

    sql["recall_at_k"] = f"{_COARSE_SCORES} SELECT query_id, k, recall FROM s"
    sql["ndcg_at_k"] = f"{_COARSE_SCORES} SELECT query_id, k, round(ndcg, 6) AS ndcg FROM s"
    sql["overlap_recall"] = f"{_COARSE_SCORES} SELECT query_id, k, round(overlap, 6) AS overlap FROM s"
    sql["eval_summary"] = f"{_COARSE_SCORES} {_summary('s')}"
    sql["fill_ratio"] = f"""WITH {_CELLS}, {_ivf('h', 100, 1)}, k(k) AS (VALUES (1), (10), (100)),
        n AS (SELECT query_id, count(*) AS returned FROM h GROUP BY query_id)
      SELECT vec_id AS query_id, k, round(least(1.0::DOUBLE, coalesce(returned, 0)::DOUBLE / k), 6) AS fill_ratio
      FROM e CROSS JOIN k LEFT JOIN n ON n.query_id = e.vec_id"""
    sql["precision_sweep"] = f"WITH {_SWEEP} {_summary('s', 'precision')}"
    pivots = ", ".join(f"round({m}_at_{k}, 6) AS {m}_at_{k}" for k in KS for m in ("recall", "ndcg"))
    sql["results_pivot"] = f"WITH {_SWEEP} SELECT 'flat' AS engine, precision, {pivots} FROM ({_PIVOT})"
    recalls = ", ".join(f"printf('%.4f', recall_at_{k})::DOUBLE AS recall_at_{k}" for k in KS)
    sql["summary_rows"] = f"""WITH {_SWEEP} SELECT 0::BIGINT AS timestamp, 'embeddings' AS dataset, 'cluster' AS mode,
        'flat' AS implementation, precision, 0::BIGINT AS indexing_time_ms, 0::BIGINT AS search_time_ms,
        0::DOUBLE AS throughput_qps,
        printf('%.2f', n_vectors * dims * element_bytes / 1048576.0::DOUBLE)::DOUBLE AS memory_usage_mb, {recalls}
      FROM ({_PIVOT}) JOIN (SELECT * FROM {_SIZES}, {_BYTES}) USING (precision)"""
    shown = ", ".join(f"printf('%.2f%%', {m}_at_{k} * 100) AS {m}_{k}" for k in (10, 100) for m in ("recall", "ndcg"))
    sql["quality_table"] = f"WITH {_SWEEP} SELECT 'flat' AS engine, upper(precision) AS precision, {shown} FROM ({_PIVOT})"
    sql["run_listing"] = f"""WITH {_SWEEP} SELECT 'flat' AS engine, precision, k, printf('%.2f%%', avg(recall) * 100) AS recall,
        printf('%.2f%%', avg(ndcg) * 100) AS ndcg FROM s GROUP BY precision, k"""
    ips, qps = _rate("num_vectors", "indexing_time_ms"), _rate("num_queries", "search_time_ms")
    pure, lookup = _rate("num_queries", "pure_search_time_ms"), _rate("num_queries", "id_lookup_time_ms")
    sql["throughput_rates"] = f"""WITH {_EVENT_RUNS} SELECT user_id, round({ips}, 6) AS throughput_ips,
        round({qps}, 6) AS throughput_qps, round({pure}, 6) AS pure_search_qps, round({lookup}, 6) AS id_lookup_qps,
        round(({ips}) / 8, 6) AS ips_per_core, round(({qps}) / 8, 6) AS qps_per_core,
        round(CASE WHEN search_time_ms > 0 THEN id_lookup_time_ms * 100.0::DOUBLE / search_time_ms ELSE 0 END, 6)
          AS lookup_overhead_pct FROM runs"""
    sql["performance_table"] = f"""WITH {_EVENT_RUNS} SELECT 'flat' AS engine, concat('USER ', user_id) AS run,
        format('{{:,}}', round_even({ips}, 0)::BIGINT) AS ips, format('{{:,}}', round_even({qps}, 0)::BIGINT) AS qps,
        {_memory('memory_bytes')} AS memory FROM runs"""
    sql["union_results"] = f"""WITH {_knn('t', 10)}, {_knn('h', 10, precision='i8')}, {_scores('s', 'h', 't', (1, 10))},
        {_scores('x', 't', 't', (1, 10))}
      SELECT 'local' AS mode, k, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, count(*) AS n_evaluated,
        -1 AS num_shards FROM s GROUP BY k
      UNION ALL SELECT 'cluster', k, round(avg(recall), 6), round(avg(ndcg), 6), count(*), 8 FROM x GROUP BY k"""

    sql["tfidf_terms"] = f"WITH {_TERMS} SELECT term, term_id, df, total, round(idf, 6) AS idf FROM terms"
    sql["tfidf_weights"] = f"""WITH {_TERMS} SELECT doc_id, term_id, tf, round(tf * idf, 6) AS weight
        FROM d JOIN terms USING (term)"""
    sql["tfidf_svd_products"] = f"""WITH {_TERMS}, cells AS (SELECT doc_id, term_id, tf * idf AS weight FROM d JOIN terms USING (term)),
        sums AS (SELECT a.doc_id, sum(a.weight * a.weight) AS square, sum(a.weight * coalesce(b.weight, 0)) AS product
          FROM cells a LEFT JOIN cells b ON b.doc_id = a.doc_id + 1 AND b.term_id = a.term_id GROUP BY a.doc_id)
      SELECT doc_id, round(coalesce(square, 0), 3) AS square, round(coalesce(product, 0), 3) AS product, TRUE AS same
        FROM documents LEFT JOIN sums USING (doc_id)"""
    sql["tfidf_svd_wide"] = sql["tfidf_svd_products"].replace("LIMIT 1024", "LIMIT 16384")
    sql["text_to_shards"] = """SELECT count(*) AS n_vectors, TRUE AS within_cap, min(doc_id) AS min_id, max(doc_id) AS max_id
        FROM documents"""
    whole = [_knn("t", 100)] + [_knn(f"h_{p}", 100, precision=p) for p in _VECTORS]
    union = " UNION ALL ".join(f"SELECT '{p}' AS precision, query_id, neighbor_id, rank FROM h_{p}" for p in _VECTORS)
    sql["run_evaluation"] = f"""WITH {', '.join(whole)}, h AS ({union}), {_scores('s', 'h', 't', by='precision')}
      SELECT engine, precision, k, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, any_value(n_vectors) AS num_queries,
        any_value(n_vectors) AS num_vectors, any_value(dims) AS dimensions,
        any_value(n_vectors * dims * element_bytes)::BIGINT AS memory_bytes
      FROM s JOIN (SELECT * FROM {_SIZES}, {_BYTES}) USING (precision), (VALUES ('flat'), ('ivf')) x(engine)
      GROUP BY engine, precision, k"""
    sql["run_evaluation_local"] = sql["run_evaluation"]
    return sql
