"""The registered queries of this subpackage: op<N>_<name>, and the pipeline."""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegate.llm import ann, chaining, chat, codes, jaccard, langid, mixing, packing, quality_cnn, rules, simhash, suffixes, turns
from tidegate.llm.text import bounded_batches, told_apart
from tidegate.session import written
from tidegate.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file is; only queries know it, operators take a path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def register(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, sf)
    QUERIES[fn.__name__] = run
    return run


@register
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@register
def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    return langid.fuse(table(spark, sf, "pages"), langid.train_text(table(spark, sf, "documents")))


@register
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality_cnn.train(docs, table(spark, sf, "labels"))
    return quality_cnn.score(docs, model).select(
        "doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    marked = written(simhash.fingerprints(table(spark, sf, "documents")), "simhash")
    return marked.join(simhash.near_classes(marked), "fp").select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@register
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), packing.PackSpec(vocabulary()))


@register
def op6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"))


@register
def op7_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    learned = rules.learn_rules(docs, table(spark, sf, "labels"))
    return (rules.text_statistics(docs).withColumn("base_failed", rules.base_failed())
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & rules.verdict(learned)).alias("kept")))


@register
def op8_chat(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))],
                                 "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_chats(said.unionByName(more)).withColumn("loss", chat.loss_text(F.col("segments")))
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@register
def op9_chaining(spark: SparkSession, sf: str) -> DataFrame:
    own = told_apart(table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    docs = own.select("doc_id", "twin", mixing.n_words(F.col("text")).alias("n_words"))
    spans = chaining.repeat_spans(own)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return docs.join(spans, ["doc_id", "twin"], "left").select(
        "doc_id", "n_words", F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("sources", F.array().cast("array<bigint>")).alias("source_ids"))


@register
def op10_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return suffixes.dedup_bytes(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link(table(spark, sf, "documents"))


@register
def op12_turns(spark: SparkSession, sf: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf, "conversations")))


@register
def op13_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.compress(table(spark, sf, "embeddings"))


def _escape_sql(col: str, t: chat.ChatTemplate = chat.ChatTemplate()) -> str:
    out = f"replace(coalesce({col}, ''), '\\', '\\\\')"
    for s in t.controls:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


SQL["op8_chat"] = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
joined AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length({_escape_sql('role')}) + length({_escape_sql('text')})
      + {len(chat.ChatTemplate().open) + len(chat.ChatTemplate().body) + len(chat.ChatTemplate().close)}) AS formatted
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars FROM joined"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL["op11_jaccard"] = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.r AS x, b.r AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT r, r FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT a.doc_id, CAST(len(any_value(a.s)) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM sets a JOIN reach ON a.r = reach.x JOIN sets b ON b.r = reach.y GROUP BY a.r, a.doc_id"""


def _turns_sql() -> str:
    """The damage, the faults and the dynamic programme, whose places are named n (nothing yet), s, u and a."""
    table_of = ("SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 "
                "THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))")
    crc = ("xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), "
           "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")
    after = {"n": "u", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}
    add = "CASE WHEN open THEN 3 ELSE 0 END"
    said = lambda role, rest: f"{role} || ':' || text || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"

    def edits(p: str) -> str:
        q = after[p]
        out = [f"{{'c': 4 + {p}.c, 'a': 'D' || {p}.a, 'r': {p}.r}}",
               f"CASE WHEN NOT gone THEN {{'c': 3 + {add} + {q}.c, 'a': 'R' || {q}.a, 'r': {said(repr(role_of[q]), f'{q}.r')}}} END",
               f"CASE WHEN NOT gone AND i = '{q}' THEN {{'c': {add} + {q}.c, 'a': 'K' || {q}.a, 'r': {said('role', f'{q}.r')}}} END"]
        if p == "n":
            out.append(f"CASE WHEN NOT gone AND i = 's' THEN {{'c': {add} + s.c, 'a': 'K' || s.a, 'r': {said('role', 's.r')}}} END")
        return f"list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))[1] AS {p}"

    def inserts(p: str, of: str) -> str:
        q = after[p]
        rest = f"CASE WHEN {q}.r = '' THEN '' ELSE chr(10) || {q}.r END"
        return f"list_sort([{p}, {{'c': 3 + {q}.c, 'a': 'I' || {q}.a, 'r': '{role_of[q]}:' || {rest}}}])[1] AS {of}"
    start = "{'c': 0, 'a': '', 'r': ''} AS n, {'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'} AS s, " \
            "{'c': 3, 'a': 'I', 'r': 'assistant:'} AS u, {'c': 0, 'a': '', 'r': ''} AS a"
    return f"""
WITH RECURSIVE crc AS ({table_of}),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM said, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
rows AS (SELECT *, left(role, 1) AS i, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS loose
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND loose AS open FROM rows),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (open) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM marked GROUP BY conv_id),
best AS (SELECT conv_id, last AS pos, {start} FROM counts
    UNION ALL SELECT conv_id, pos, {inserts('n', 'n')}, {inserts('s', 's')}, u, a FROM (
        SELECT conv_id, pos, n, s, {inserts('u', 'u')}, {inserts('a', 'a')} FROM (
            SELECT b.conv_id, b.pos - 1 AS pos, {', '.join(edits(p) for p in 'nsua')}
            FROM best b JOIN marked m ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.pos = m.pos) e) f),
done AS (SELECT conv_id, n.c AS cost, n.a AS audit, sha256(n.r) AS repaired_sha256 FROM best WHERE pos = 0)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id"""


def _codes_sql(spec: codes.CodeSpec = codes.CodeSpec()) -> str:
    steps = []
    for k in range(spec.rounds + 1):
        steps.append(f"""
near{k} AS (SELECT r, p, e, d FROM (SELECT a.r, a.p, b.e, sum((a.x - b.x) * (a.x - b.x)) AS d FROM part a JOIN book{k} b ON a.p = b.p AND a.c = b.c
    GROUP BY a.r, a.p, b.e) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if k < spec.rounds:
            steps.append(f"""
mean{k} AS (SELECT n.p, n.e, a.c, sum(a.x) AS s, count(*) AS m FROM near{k} n JOIN part a ON n.r = a.r AND n.p = a.p GROUP BY ALL),
book{k + 1} AS (SELECT b.p, b.e, b.c, CAST(coalesce((s - ((s % m) + m) % m) // m, b.x) AS BIGINT) AS x
    FROM book{k} b LEFT JOIN mean{k} n ON b.p = n.p AND b.e = n.e AND b.c = n.c)""")
    last = spec.rounds
    return f"""
WITH fine AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
width AS (SELECT CAST(ceil(max(len(v)) / {spec.parts}) AS BIGINT) AS w FROM fine),
part AS (SELECT r, j // w AS p, j % w AS c, CAST(floor({spec.scale} * CAST(coalesce(v[j + 1], 0) AS DOUBLE)) AS BIGINT) AS x
    FROM fine, width, range({spec.parts} * w) i(j)),
book0 AS (SELECT p, r AS e, c, x FROM part WHERE r < {spec.entries}),{','.join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, c)) FROM book{last}) AS codebooks_sha256
FROM coded JOIN fine USING (r)"""


SQL["op12_turns"] = _turns_sql()
SQL["op13_codes"] = _codes_sql()
