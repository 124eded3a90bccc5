"""Queries over the driver's tables, one or more for each operator family, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import exprs as X
from gradeloom.functions import prompts as P
from gradeloom.operators import analyze, curate, curriculum, grade, judge, prepare
from gradeloom.plans import adapters as A
from gradeloom.sources import readers, writers
from gradeloom.sources.saved import shared_folder
from gradeloom.streaming import checkpoints

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Adapter tables in SQL, by name.
VIEWS = {
    "p": """p AS (SELECT d.doc_id AS pos, CAST(d.doc_id AS VARCHAR) AS idx, d.source AS dataset, l.quality AS is_correct, d.n_chars AS tokens,
      CASE WHEN d.n_chars > 4000 THEN 'length' WHEN d.n_chars >= 150 THEN 'stop' END AS finish_reason,
      CASE WHEN d.doc_id % 3 = 1 THEN 'can_not_extract' ELSE 'no_match' END AS reason,
      CASE d.doc_id % 4 WHEN 0 THEN 'solution' WHEN 1 THEN 'thought' WHEN 2 THEN 'none' END AS last_box_source,
      CASE d.doc_id % 3 WHEN 0 THEN 'short_think' WHEN 1 THEN 'missing_think' ELSE 'reasoning_think' END AS think_type
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "t": """t AS (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'NaN'::DOUBLE ELSE CAST(200 + doc_id % 7 * 300 AS DOUBLE) END AS train FROM documents WHERE lang <> 'es')""",
    "r": """r AS (SELECT p.*, t.train, CASE WHEN isnan(t.train) OR t.train > 0 THEN p.tokens / t.train END AS ratio FROM p LEFT JOIN t ON p.pos = t.doc_id)""",
    "g": """g AS (SELECT *, CASE WHEN ratio IS NULL THEN NULL WHEN isnan(ratio) THEN 1 WHEN ratio >= 2 THEN 7 WHEN ratio >= 1.5 THEN 6 WHEN ratio >= 1.2 THEN 5 WHEN ratio >= 1 THEN 4 WHEN ratio >= 0.8 THEN 3 WHEN ratio >= 0.5 THEN 2 ELSE 1 END AS grp FROM r)""",
    "s": r"""s AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS idx, text AS question, text || repeat(' \boxed{1}', CAST(doc_id % 4 AS BIGINT)) || ' end' AS solution,
      CASE WHEN doc_id % 3 = 0 THEN text END AS thought, CAST(n_chars AS VARCHAR) AS final_answer, n_chars AS total_token, source FROM documents)""",
    "h": """h AS (SELECT CAST(doc_id AS VARCHAR) AS idx, CASE WHEN doc_id % 5 <> 0 THEN 'use ' || lang ELSE '' END AS hint, lang FROM documents)""",
    "o": r"""o AS (SELECT doc_id, CAST(n_chars AS VARCHAR) AS label, text AS t, length(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS tl FROM documents)""",
}
WS = r"\x09-\x0D\x1C-\x20\x85\xA0"


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL after the views it reads."""

    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(VIEWS[v] for v in views) + " " if views else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Curation


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 1950")
def threshold_filter(spark, sf):
    return curate.threshold(A.table(spark, sf, "documents", "doc_id", "n_chars"), "n_chars", 1950)


@query("SELECT idx AS \"index\", md5('9:' || idx) AS sample_order FROM s ORDER BY md5('9:' || idx), idx LIMIT 100", "s")
def sample_exact_n(spark, sf):
    return curate.sample(A.dataset(spark, sf).select("index"), 100, 9).select("index", F.col("_order").alias("sample_order"))


@query("SELECT x.idx AS \"index\", h.hint FROM (SELECT idx FROM s WHERE total_token <= 1950 ORDER BY md5('9:' || idx), idx LIMIT 100) x JOIN h ON x.idx = h.idx", "sh")
def align_hints(spark, sf):
    chosen = curate.sample(curate.threshold(A.dataset(spark, sf), "total_token", 1950), 100, 9)
    return curate.align(chosen, A.hints(spark, sf).drop("_pos", "lang")).select("index", F.col("detailed_method_hint").alias("hint"))


@query("SELECT idx AS \"index\", final_answer FROM s WHERE idx NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)", "s")
def anti_invalid(spark, sf):
    return curate.without_keys(A.dataset(spark, sf), _invalid(spark, sf)).select("index", "final_answer")


def _invalid(spark, sf):
    return A.table(spark, sf, "labels", "doc_id", "quality").where("quality = 0").select(F.col("doc_id").cast("string").alias("index"))


@query(r"""SELECT idx AS "index", CAST((length(solution) - length(replace(solution, '\boxed{', ''))) // 7 AS BIGINT) AS boxes FROM s""", "s")
def boxed_count(spark, sf):
    return A.dataset(spark, sf).select("index", X.boxed_count(F.col("solution")).cast("long").alias("boxes"))


@query("SELECT idx AS \"index\" FROM s WHERE pos % 4 <= 1", "s")
def single_box_filter(spark, sf):
    return curate.single_box(A.dataset(spark, sf)).select("index")


@query("""SELECT count(*) AS original, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 0) AS invalid_in_file, count(l.doc_id) AS invalid_matched, count(*) - count(l.doc_id) AS after_invalid,
  count(*) FILTER (WHERE l.doc_id IS NULL AND pos % 4 > 1) AS multi_box, count(*) FILTER (WHERE l.doc_id IS NULL AND pos % 4 <= 1) AS after_multi_box,
  count(*) FILTER (WHERE l.doc_id IS NULL AND pos % 4 <= 1 AND s.idx IN (SELECT idx FROM h WHERE lang <> 'de')) AS hints
  FROM s LEFT JOIN labels l ON s.pos = l.doc_id AND l.quality = 0""", "sh")  # fmt: skip
def filter_funnel(spark, sf):
    return curate.funnel(A.dataset(spark, sf), _invalid(spark, sf), hints=A.hints(spark, sf).where("lang <> 'de'"))


@query("""SELECT coalesce(source, '<all>') AS split, count(*) AS rows, count(*) FILTER (WHERE pos % 4 > 1) AS multi_rows FROM s GROUP BY ROLLUP (source)""", "s")
def multi_box_totals(spark, sf):
    return curate.multi_box_totals(A.dataset(spark, sf), "source")


@query("""SELECT count(*) AS rows, count(*) - count(k) AS null_count, count(DISTINCT k) AS unique_count, count(k) - count(DISTINCT k) AS duplicate_count
  FROM (SELECT CASE WHEN doc_id % 10 <> 0 THEN source END AS k FROM documents)""")  # fmt: skip
def key_profile(spark, sf):
    return curate.key_profile(A.dataset(spark, sf).select(F.when(F.col("_pos") % 10 != 0, F.col("source")).alias("index")))


@query("""SELECT source AS "index", count(*) AS n, min(doc_id) AS first_pos, list_sort(list(doc_id))[2] AS second_pos FROM documents GROUP BY source HAVING count(*) > 1 ORDER BY second_pos LIMIT 10""")
def duplicate_examples(spark, sf):
    return curate.duplicate_examples(A.dataset(spark, sf).select("_pos", F.col("source").alias("index")))


@query("""SELECT * FROM (SELECT 'left' AS side, CAST(doc_id AS VARCHAR) AS "index" FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY 2 LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'right' AS side, CAST(doc_id AS VARCHAR) AS "index" FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) ORDER BY 2 LIMIT 10)""")  # fmt: skip
def overlap_examples(spark, sf):
    right = A.table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("index"))
    return curate.overlap_examples(A.dataset(spark, sf), right)


@query("""SELECT doc_id, row_number() OVER () - 1 AS position FROM documents""")
def row_positions(spark, sf):
    """Each row's position in its file."""
    return readers.positioned(A.table(spark, sf, "documents", "doc_id")).select("doc_id", F.col("_pos").alias("position"))


@query("""SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only,
  count(*) FILTER (WHERE r IS NULL) = 0 AND count(*) FILTER (WHERE l IS NULL) = 0 AS equal
  FROM (SELECT d.doc_id AS l, b.doc_id AS r FROM documents d FULL JOIN labels b ON d.doc_id = b.doc_id)""")  # fmt: skip
def key_overlap(spark, sf):
    right = A.table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("index"))
    return curate.key_overlap(A.dataset(spark, sf), right)


@query("""SELECT s.idx AS "index", s.question, s.final_answer, h.hint FROM s JOIN h ON s.idx = h.idx""", "sh")
def review_records(spark, sf):
    return curate.review_records(A.dataset(spark, sf), A.hints(spark, sf).drop("_pos", "lang")).drop("_pos")


@query("""SELECT doc_id, n, (n - 1) // 100 + 1 AS part, (SELECT (count(*) + 99) // 100 FROM documents) AS parts, (n - 1) // 100 * 100 + 1 AS row_from,
  least(((n - 1) // 100 + 1) * 100, (SELECT count(*) FROM documents)) AS row_to FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)""")  # fmt: skip
def chunk_ranges(spark, sf):
    return writers.chunked(A.table(spark, sf, "documents", "doc_id"), "doc_id", 100).withColumnRenamed("_n", "n")


@query("""SELECT CAST(doc_id AS VARCHAR) AS "index", CASE WHEN n_chars <= 2000 THEN 'le2000' ELSE 'gt2000' END AS split FROM documents""")
def split_fan_out(spark, sf):
    d = A.dataset(spark, sf).select("index", "total_token")
    return curate.fan_out({"le2000": d.where("total_token <= 2000"), "gt2000": d.where("total_token > 2000")}).select("index", "split")


@query("""SELECT source, coalesce(nullif(regexp_extract(name, '(?:^|_)((?:le|gt)\\d+)(?:_|$)', 1), ''), source) AS split FROM (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'set_le2000_seed9' ELSE 'set9' END AS name FROM documents)""".replace("\\\\", "\\"))
def split_names(spark, sf):
    d = A.dataset(spark, sf).select("source", F.when(F.col("_pos") % 2 == 0, "set_le2000_seed9").otherwise("set9").alias("name"))
    return d.select("source", X.split_name(F.col("name"), fallback=F.col("source")).alias("split"))


# Prompts and training records

_Q = r"'Put the final answer inside \boxed{}. ' || question"


@query(f"""SELECT s.idx AS "index", {_Q} || CASE WHEN hint = '' THEN '' ELSE chr(10) || chr(10) || 'Hint: ' || hint END AS prompt FROM s JOIN h ON s.idx = h.idx""", "sh")
def prompt_render(spark, sf):
    d = A.dataset(spark, sf).join(A.hints(spark, sf).drop("_pos", "lang"), "index")
    return d.select("index", P.prompt_text(F.col("question"), F.col("detailed_method_hint")).alias("prompt"))


@query(f"""SELECT s.idx AS "index", CASE WHEN lang <> 'de' THEN hint END AS hint, '<|im_start|>user' || chr(10) || {_Q} || CASE WHEN lang = 'de' OR hint = '' THEN '' ELSE chr(10) || chr(10) || 'Hint: ' || hint END
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS input_text FROM s JOIN h ON s.idx = h.idx""", "sh")  # fmt: skip
def hint_left_join(spark, sf):
    hints = A.hints(spark, sf).where("lang <> 'de'").drop("lang")
    return prepare.inference_inputs(A.dataset(spark, sf).drop("source"), hints, "detailmethod", system=None).select("index", "hint", "input_text")


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, text) AS chat FROM conversations GROUP BY conv_id""")
def chat_render(spark, sf):
    c = A.table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("string").alias("reasoning_content")))
    return c.groupBy("conv_id").agg(m.alias("m")).select("conv_id", P.chat_concise(F.col("m")).alias("chat"))


#: Reasoning after the last question alone; a run of tool answers (turns 3 and 4 of a conversation, told by their text) shares a block.
_TOOL_ROLE = "CASE WHEN role = 'user' AND turn IN (2, 3) THEN 'tool' ELSE role END"


@query(f"""WITH c AS (SELECT conv_id, text, {_TOOL_ROLE} AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
  q AS (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN n END) OVER (PARTITION BY conv_id), total) AS last_user, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY n) AS after FROM c)
  SELECT conv_id, CASE WHEN max(CASE WHEN n = 1 AND role = 'system' THEN 1 ELSE 0 END) = 1 THEN '<|im_start|>system' || chr(10) || max(CASE WHEN n = 1 AND role = 'system' THEN text END) || chr(10) || chr(10) ELSE '<|im_start|>system' || chr(10) END || ? || '<|im_end|>' || chr(10)
    || string_agg(CASE
      WHEN role = 'user' OR (role = 'system' AND n > 1) THEN '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
      WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || CASE WHEN n > last_user THEN '<think>' || chr(10) || 'why' || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10)
      WHEN role = 'tool' THEN CASE WHEN n = 1 OR before <> 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || CASE WHEN after IS NULL OR after <> 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
      ELSE '' END, '' ORDER BY n) AS chat FROM q GROUP BY conv_id""".replace("?", "'" + (P.TOOLS_BEGIN + '\n{"name": "look"}' + P.TOOLS_END).replace("'", "''") + "'"))  # fmt: skip
def chat_with_tools(spark, sf):
    c = A.table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumn("role", F.when((F.col("role") == "user") & F.col("turn").isin(2, 3), "tool").otherwise(F.col("role")))
    calls = F.lit(None).cast("array<struct<name:string,arguments:string>>").alias("tool_calls")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.when(x["role"] == "assistant", F.lit("why")).alias("reasoning_content"), calls))
    return c.groupBy("conv_id").agg(m.alias("m")).select("conv_id", P.chat_full(F.col("m"), tools=['{"name": "look"}']).alias("chat"))


_CLEAN = rf"regexp_replace(%s, '^[{WS}]+|[{WS}]+$', '', 'g')"
_TH = _CLEAN % "coalesce(thought, '')"
_OUT = f"CASE WHEN {_TH} <> '' THEN '<think>' || chr(10) || {_TH} || chr(10) || '</think>' || chr(10) || {_CLEAN % 'solution'} ELSE {_CLEAN % 'solution'} END"


@query(f"""SELECT idx AS "index", {_CLEAN % "question"} AS instruction, {_OUT} AS output FROM s WHERE {_CLEAN % "question"} <> '' AND {_CLEAN % "solution"} <> ''""", "s")
def sft_records(spark, sf):
    return prepare.sft_records(A.dataset(spark, sf)).select("index", "instruction", "output")


@query(f"""SELECT idx AS "index", {_OUT.replace(_CLEAN % "solution", "solution")} AS output FROM s""", "s")
def think_wrapper(spark, sf):
    return A.dataset(spark, sf).select("index", P.with_thought(X.clean_text(F.col("thought")), F.col("solution")).alias("output"))


@query(f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {_CLEAN % "question"} = '' OR {_CLEAN % "solution"} = '') AS skipped FROM s""", "s")
def sft_skipped(spark, sf):
    return prepare.skipped(A.dataset(spark, sf))


@query("""SELECT doc_id, array_to_string(list_transform(generate_series(1, least(2048, n_chars)), lambda x: CASE WHEN x <= 5 THEN -100 ELSE x END), ',') AS labels FROM documents""")
def label_mask(spark, sf):
    d = A.table(spark, sf, "documents", "doc_id", "n_chars")
    ids = X.truncated(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n_chars"), F.lit(1))), 2048)
    return d.select("doc_id", F.array_join(X.label_mask(ids, F.lit(5)).cast("array<string>"), ",").alias("labels"))


@query("""SELECT idx AS "index", row_number() OVER (ORDER BY md5('9:' || pos), pos) AS n FROM s QUALIFY n <= 50""", "s")
def seeded_shuffle(spark, sf):
    d = prepare.shuffled(A.dataset(spark, sf).select("_pos", "index"), 9, 50)
    return d.select("index", F.row_number().over(analyze.Window.orderBy("_order", "_pos")).cast("long").alias("n"))


@query("""SELECT s.idx AS "index", k.n AS pos, s.final_answer FROM s JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM labels) k ON s.pos = k.doc_id""", "s")
def ordered_lookup(spark, sf):
    """Keys written to a file in an order, read in that order, and looked up."""
    keys = A.table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("index"), F.md5(F.col("doc_id").cast("string")).alias("_pos"))
    path = shared_folder(spark)
    writers.write_keys(keys, path)
    found = prepare.in_key_order(A.dataset(spark, sf), readers.ordered_keys(spark, path))
    return found.select("index", (F.col("_pos") + 1).alias("pos"), "final_answer")


@query("""SELECT idx AS "index" FROM s WHERE pos NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""", "s")
def pending(spark, sf):
    done = A.table(spark, sf, "labels", "doc_id", "quality").where("quality = 1").select(F.col("doc_id").alias("index"))
    return prepare.pending(A.dataset(spark, sf), done).select("index")


@query("""SELECT idx AS "index" FROM s WHERE pos NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY pos LIMIT 100""", "s")
def pending_first(spark, sf):
    """The first hundred rows that aren't done."""
    done = A.table(spark, sf, "labels", "doc_id", "quality").where("quality = 1").select(F.col("doc_id").alias("index"))
    return prepare.pending(A.dataset(spark, sf), done, 100).select("index")


@query("""SELECT event_id AS problem_idx, event_type FROM events ORDER BY event_id LIMIT 50""")
def first_problems(spark, sf):
    """The first fifty problems of a set, by number."""
    e = A.table(spark, sf, "events", "event_id", "event_type").withColumnRenamed("event_id", "problem_idx")
    return readers.selected_problems(e, limit=50)


@query("""SELECT s.source AS dataset, s.idx AS "index", s.final_answer AS label, s.question FROM s JOIN p ON s.pos = p.pos WHERE p.finish_reason = 'length'""", "sp")
def retry_semi(spark, sf):
    _, cut = prepare.split_by_length(A.predictions(spark, sf))
    return prepare.retry_records(A.dataset(spark, sf).withColumnRenamed("source", "dataset"), cut).drop("_pos")


@query("""SELECT idx AS "index", CASE WHEN finish_reason = 'length' THEN 'retry' ELSE 'kept' END AS phase FROM p""", "p")
def retry_union(spark, sf):
    kept, cut = prepare.split_by_length(A.predictions(spark, sf))
    return prepare.retried(kept.select("index", F.lit("kept").alias("phase")), cut.select("index", F.lit("retry").alias("phase")))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE finish_reason IS NULL OR finish_reason <> 'length') AS kept, count(*) FILTER (WHERE finish_reason = 'length') AS cut FROM p""", "p")
def length_counts(spark, sf):
    return prepare.length_counts(A.predictions(spark, sf))


@query("""SELECT pos, 'run' AS run_id, source AS dataset, idx AS "index", question, final_answer AS label, text AS model_output, CAST(len(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> '')) AS INTEGER) AS output_token_length, p.finish_reason
  FROM s JOIN p USING (pos, idx) JOIN documents d ON d.doc_id = pos""".replace("source AS dataset", "s.source AS dataset").replace("'[\\s]+'", r"'[\s\x0B\x1C-\x1F\x85\xA0]+'"), "sp")  # fmt: skip
def output_rows(spark, sf):
    """Outputs with their inputs' fields and their words."""
    ins = A.dataset(spark, sf).select("_pos", F.col("source").alias("dataset"), "index", "question", F.col("final_answer").alias("label"))
    outs = A.predictions(spark, sf).select("_pos", "finish_reason").join(A.table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("_pos"), F.col("text").alias("model_output")), "_pos")
    return prepare.assembled(ins, outs, "run").withColumnRenamed("_pos", "pos")


@query("""SELECT max(n) AS max_tokens, min(n) AS min_tokens, avg(n) AS mean_tokens, CAST(sum(n) AS BIGINT) AS sum_tokens FROM (SELECT n_chars AS n FROM documents)""")
def token_stats(spark, sf):
    return prepare.token_stats(A.table(spark, sf, "documents", "n_chars"), "n_chars")


# Grading


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS "index", CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 1 ELSE 0 END AS is_correct,
  CASE doc_id % 6 WHEN 0 THEN 'literal_match' WHEN 1 THEN 'numeric_match' WHEN 2 THEN 'no_match' WHEN 4 THEN 'literal_match' ELSE 'can_not_extract' END AS reason,
  CASE doc_id % 6 WHEN 0 THEN 'solution' WHEN 1 THEN 'solution' WHEN 2 THEN 'thought' WHEN 4 THEN 'solution' ELSE 'none' END AS last_box_source,
  CASE WHEN doc_id % 6 = 1 THEN 'short_think' WHEN doc_id % 6 = 2 THEN 'unclosed_think' WHEN doc_id % 6 >= 4 THEN 'missing_think' WHEN tl < 50 THEN 'short_think' ELSE 'reasoning_think' END AS think_type FROM o""", "o")  # fmt: skip
def grade_answers(spark, sf):
    return grade.grade(A.outputs(spark, sf)).select("index", "is_correct", "reason", "last_box_source", "think_type")


def _answer_sql(column: int) -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(i, x[column].replace("'", "''")) for i, x in enumerate(A.ANSWERS))
    return f"replace(CASE doc_id % {len(A.ANSWERS)} {cases} END, '{{n}}', CAST(n_chars AS VARCHAR))"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS "index", {_answer_sql(2)} AS reason, CASE WHEN doc_id % {len(A.ANSWERS)} = 13 THEN CAST(n_chars AS VARCHAR) ELSE {_answer_sql(1)} END AS extracted_answer FROM documents""".replace("ELSE replace(", "ELSE trim(replace(", 1).replace("VARCHAR)) END AS extracted", "VARCHAR))) END AS extracted", 1))
def grade_forms(spark, sf):
    return grade.grade(A.answers(spark, sf)).select("index", "reason", F.trim("extracted_answer").alias("extracted_answer"))


@query(r"""SELECT CASE WHEN doc_id % 6 = 1 THEN 'short_think' WHEN doc_id % 6 = 2 THEN 'unclosed_think' WHEN doc_id % 6 >= 4 THEN 'missing_think' WHEN tl < 50 THEN 'short_think' ELSE 'reasoning_think' END AS think_type, count(*) AS n FROM o GROUP BY 1""", "o")
def think_type(spark, sf):
    return grade.grade(A.outputs(spark, sf)).groupBy("think_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN doc_id % 6 IN (0, 1, 4) THEN 'solution' WHEN doc_id % 6 = 2 THEN 'thought' ELSE 'none' END AS last_box_source, count(*) AS n FROM o GROUP BY 1""", "o")
def last_box_source(spark, sf):
    return grade.grade(A.outputs(spark, sf)).groupBy("last_box_source").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT coalesce(source, '<all>') AS dataset, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE NOT ok) AS incorrect, 100.0::DOUBLE * count(*) FILTER (WHERE ok) / count(*) AS accuracy,
  avg(n_chars) AS avg_tokens, avg(n_chars) FILTER (WHERE ok) AS avg_tokens_correct, avg(n_chars) FILTER (WHERE NOT ok) AS avg_tokens_incorrect
  FROM (SELECT source, n_chars, doc_id % 6 IN (0, 1, 4) AS ok FROM documents) GROUP BY ROLLUP (source)""")  # fmt: skip
def benchmark_by_dataset(spark, sf):
    return analyze.benchmark(grade.grade(A.outputs(spark, sf)).withColumn("output_token_length", F.col("label")))


@query(rf"""SELECT CAST(doc_id AS VARCHAR) AS "index", CASE WHEN doc_id % 3 = 1 THEN 'no slice' || '</think>' || t WHEN doc_id % 4 = 0 THEN {_CLEAN % 't'} WHEN doc_id % 4 = 1 THEN 'no slice' ELSE 'no slice' || '</think>' || t END AS model_output FROM o""", "o")
def review_slice(spark, sf):
    d = A.table(spark, sf, "documents", "doc_id", "text")
    out = F.concat(F.lit("no slice</think>"), F.col("text"))
    reason, source = A.pick(3, "no_match", "can_not_extract", "no_match"), A.pick(4, "solution", "thought", "none", None)
    return d.select(F.col("doc_id").cast("string").alias("index"), X.review_slice(reason, source, out).alias("model_output"))


# Analysis


@query("""SELECT coalesce(finish_reason, '<missing>') AS value, count(*) AS n, min(pos) AS first_pos, row_number() OVER (ORDER BY count(*) DESC, min(pos)) AS rank FROM p GROUP BY 1""", "p")
def counter_first_seen(spark, sf):
    return analyze.counter(A.predictions(spark, sf), "finish_reason")


@query("""SELECT dataset, count(tokens) AS n, quantile_cont(tokens, 0.25) AS q1, quantile_cont(tokens, 0.5) AS q2, quantile_cont(tokens, 0.75) AS q3, avg(tokens) AS mean FROM p GROUP BY dataset""", "p")
def token_quantiles(spark, sf):
    return analyze.quantiles(A.predictions(spark, sf), "output_token_length", ["dataset"])


@query("""SELECT coalesce(finish_reason, '<missing>') AS finish_reason, coalesce(reason, '<missing>') AS reason, coalesce(last_box_source, '<missing>') AS last_box_source, coalesce(think_type, '<missing>') AS think_type,
  count(*) AS n, min(pos) AS first_pos, CASE coalesce(finish_reason, '<missing>') WHEN 'length' THEN 0 WHEN 'stop' THEN 1 ELSE 2 END AS finish_rank FROM p WHERE is_correct = 0 GROUP BY 1, 2, 3, 4, 7""", "p")  # fmt: skip
def negative_breakdown(spark, sf):
    return analyze.breakdown(A.predictions(spark, sf))


@query("""SELECT pos, idx AS "index", coalesce(last_box_source, '<missing>') AS last_box_source FROM p WHERE is_correct = 0 AND coalesce(last_box_source, '<missing>') IN ('none', '<missing>')""", "p")
def unboxed_indexes(spark, sf):
    return analyze.unboxed_indexes(A.predictions(spark, sf)).withColumnRenamed("_pos", "pos")


_HIST = """SELECT CAST(b.k AS INTEGER) AS ratio_group, b.bucket, count(x.grp) AS n FROM (VALUES (1, '<0.5'), (2, '0.5-0.8'), (3, '0.8-1.0'), (4, '1.0-1.2'), (5, '1.2-1.5'), (6, '1.5-2.0'), (7, '>=2.0')) b(k, bucket)
  LEFT JOIN (SELECT grp FROM g WHERE is_correct = 1) x ON b.k = x.grp GROUP BY 1, 2"""


@query(_HIST, "ptrg")
def positive_ratio_hist(spark, sf):
    rows = analyze.with_ratio(analyze.flagged(A.predictions(spark, sf)).where(analyze.OK), A.tokens(spark, sf))
    return analyze.ratio_histogram(rows)


@query("""SELECT idx AS "index", pos IN (SELECT doc_id FROM labels WHERE toxic = 0) AS has_generation, CAST(CASE WHEN pos IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN tokens + 10 ELSE tokens END AS DOUBLE) AS output_token_length FROM p WHERE is_correct = 1""", "p")
def positive_join(spark, sf):
    p = A.predictions(spark, sf)
    gens = p.join(A.labelled(spark, sf, 0), "index").select("index", (F.col("output_token_length") + 10).alias("output_token_length"))
    return analyze.positives(p, gens, A.tokens(spark, sf)).select("index", "has_generation", "output_token_length")


@query("""SELECT dataset, coalesce(finish_reason, '<missing>') AS finish_reason, count(*) AS n, count(*) FILTER (WHERE is_correct = 1) AS correct, count(*) FILTER (WHERE coalesce(is_correct, 0) <> 1) AS incorrect, avg(tokens) AS avg_tokens,
  CASE coalesce(finish_reason, '<missing>') WHEN 'stop' THEN 0 WHEN 'length' THEN 1 ELSE 2 END AS finish_rank FROM p GROUP BY 1, 2, 7""", "p")  # fmt: skip
def finish_matrix(spark, sf):
    return analyze.finish_matrix(A.predictions(spark, sf))


@query("""SELECT dataset, idx AS "index", row_number() OVER (PARTITION BY dataset ORDER BY pos) AS case_number FROM p WHERE coalesce(is_correct, 0) <> 1""", "p")
def case_number(spark, sf):
    return analyze.case_numbers(A.predictions(spark, sf)).select("dataset", "index", "case_number")


@query("""SELECT pos AS p_pos, CASE WHEN finish_reason = 'stop' THEN pos END AS g_pos FROM p""", "p")
def occurrence_join(spark, sf):
    p = A.predictions(spark, sf)
    return analyze.occurrence_join(p, p.where("finish_reason = 'stop'"))


@query("""WITH RECURSIVE p AS (SELECT doc_id % 500 AS k, doc_id AS pos, coalesce(source, '') AS ds, row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id) AS n FROM documents),
  g AS (SELECT k, list(ds ORDER BY pos * 48271 % 2147483647) AS ds, list(pos * 48271 % 2147483647 ORDER BY pos * 48271 % 2147483647) AS pos FROM p GROUP BY k),
  f AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS p_pos, CAST(NULL AS BIGINT) AS g_pos, CAST(1 AS BIGINT) AS cur FROM g
    UNION ALL SELECT k, n, p_pos, pos[CAST(least(hit, len(pos)) AS BIGINT)], CASE WHEN hit <= len(pos) THEN hit + 1 ELSE cur END
    FROM (SELECT f.k, p.n, p.pos AS p_pos, g.pos, f.cur, f.cur + coalesce(nullif(list_position(list_slice(g.ds, f.cur, len(g.ds)), p.ds), 0) - 1, 0) AS hit FROM f JOIN p ON p.k = f.k AND p.n = f.n + 1 JOIN g ON g.k = f.k))
  SELECT p_pos, g_pos FROM f WHERE n > 0""")  # fmt: skip
def occurrence_join_repeated(spark, sf):
    """Repeated keys: the cursor decides."""
    p = A.predictions(spark, sf).withColumn("index", (F.col("_pos") % 500).cast("string"))
    g = p.select("index", "dataset", (F.col("_pos") * 48_271 % 2_147_483_647).alias("_pos"))
    return analyze.occurrence_join(p, g)


@query("""SELECT finish_reason, reason, kind, value, count(*) AS n, min(pos) AS first_pos FROM (
  SELECT coalesce(finish_reason, '<missing>') AS finish_reason, 'llm_judge' AS reason, unnest(['think_type', 'last_box_source']) AS kind, unnest([coalesce(think_type, '<missing>'), coalesce(last_box_source, '<missing>')]) AS value, pos FROM p WHERE is_correct = 0)
  GROUP BY 1, 2, 3, 4""", "p")  # fmt: skip
def other_reasons(spark, sf):
    return analyze.other_reasons(A.predictions(spark, sf).withColumn("reason", F.lit("llm_judge")))


# Judgement and curriculum


def _confirmed(spark, sf):
    return A.labelled(spark, sf, 1)


_CONF = "(SELECT doc_id FROM labels WHERE toxic = 1)"


@query(f"""SELECT idx AS "index", CASE WHEN pos IN {_CONF} THEN 1 ELSE is_correct END AS is_correct, CASE WHEN pos IN {_CONF} THEN 'llm_judge' ELSE reason END AS reason FROM p""", "p")
def judgement_upsert(spark, sf):
    return judge.apply_verdicts(A.predictions(spark, sf), _confirmed(spark, sf)).select("index", "is_correct", "reason")


@query(f"""SELECT idx AS "index" FROM p WHERE is_correct = 0 AND pos NOT IN {_CONF}""", "p")
def suspects_minus_confirmed(spark, sf):
    bad = analyze.flagged(A.predictions(spark, sf)).where("_bad")
    return judge.without_confirmed(bad, _confirmed(spark, sf)).select("index")


@query("""SELECT p.idx AS "index", d.text AS question, CAST(d.n_chars AS VARCHAR) AS label FROM p JOIN documents d ON p.pos = d.doc_id WHERE is_correct = 0""", "p")
def suspect_records(spark, sf):
    return judge.suspects(A.predictions(spark, sf), A.outputs(spark, sf)).select("index", "question", "label")


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE pos IN {_CONF}) AS updated, (SELECT count(*) FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT pos FROM p WHERE finish_reason = 'stop')) AS missing,
  count(*) FILTER (WHERE is_correct = 0 AND pos IN {_CONF}) AS removed FROM p WHERE finish_reason = 'stop'""", "p")  # fmt: skip
def verdict_counts(spark, sf):
    """Of the rows that stopped; the verdicts on others have no row."""
    p = A.predictions(spark, sf).where("finish_reason = 'stop'")
    return judge.verdict_counts(p, _confirmed(spark, sf), p.where("is_correct = 0"))


_POOL = """k AS (SELECT *, CASE WHEN coalesce(is_correct, 0) <> 1 THEN 'incorrect' WHEN grp IS NULL THEN 'missing' WHEN grp <= 2 THEN 'group_1_2' ELSE 'group_' || grp END AS pool FROM g),
  w AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('9:' || idx), idx) AS rn, count(*) OVER (PARTITION BY pool) AS c FROM k),
  b AS (SELECT count(*) FILTER (WHERE pool IN ('incorrect', 'group_5', 'group_6', 'group_7')) + count(*) FILTER (WHERE pool = 'group_4') // 2 + count(*) FILTER (WHERE pool = 'group_3') // 2 AS base, count(*) FILTER (WHERE pool = 'group_1_2') // 2 AS extra FROM k),
  v AS (SELECT w.*, pool IN ('incorrect', 'group_5', 'group_6', 'group_7') OR (pool IN ('group_3', 'group_4') AND rn <= c // 2) OR (pool = 'group_1_2' AND rn <= b.extra) AS hard FROM w, b)"""


def _split(spark, sf):
    rows = curriculum.ranked(curriculum.annotated(A.predictions(spark, sf), A.tokens(spark, sf)), 9)
    n = curriculum.pool_sizes(rows)
    target = curriculum.base_size(n) + n.get("group_1_2", 0) // 2
    return curriculum.chosen(rows, n, target), target


VIEWS["q"] = _POOL


@query("""SELECT idx AS "index", pool, hard FROM v""", "ptrgq")
def curriculum_split(spark, sf):
    return _split(spark, sf)[0].select("index", "pool", "hard")


@query("""SELECT pool, count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE NOT hard) AS easy FROM v GROUP BY pool""", "ptrgq")
def curriculum_ledger(spark, sf):
    return curriculum.ledger(_split(spark, sf)[0])


@query("""SELECT count(*) FILTER (WHERE hard) AS hard, count(*) FILTER (WHERE NOT hard) AS easy, CAST(0 AS BIGINT) AS overlap, count(*) AS "union", true AS target_met FROM v""", "ptrgq")
def curriculum_check(spark, sf):
    return curriculum.self_check(*_split(spark, sf))


# Logs and folds


@query("""SELECT user_id AS "index", max(event_id) AS pos, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def keep_last(spark, sf):
    e = A.table(spark, sf, "events", "event_id", "user_id", "event_type")
    last = readers.last_per_key(e.select(F.col("user_id").alias("index"), F.col("event_id").alias("_pos"), "event_type"))
    return last.select("index", F.col("_pos").alias("pos"), F.col("event_type").alias("last_type"))


@query("""SELECT CAST(sum(user_id) AS BIGINT) AS input_tokens, CAST(sum(user_id // 2) AS BIGINT) AS cached_input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS total_tokens,
  CAST(sum(user_id // 2) AS DOUBLE) / CAST(sum(user_id) AS DOUBLE) AS cache_ratio FROM events""")  # fmt: skip
def usage_totals(spark, sf):
    e = A.table(spark, sf, "events", "event_id", "user_id")
    body = F.parse_json(F.format_string('{"usage":{"input_tokens":0,"prompt_tokens":%d,"prompt_tokens_details":{"cached_tokens":%d},"output_tokens":%d}}', "user_id", F.expr("user_id div 2"), F.col("event_id") % 100))
    return checkpoints.usage_totals(e.select(X.usage(body).alias("u")).select("u.*"))


_HINT = r"""'{"concise_hint":" ' || lang || '","detailed_method_hint":"a\n\n b ","detailed_scaffold_hint":["x ",""]}'"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN '{{"body":{{"output":[{{"content":[{{"text":' || CAST(to_json(CASE WHEN doc_id % 2 = 0 THEN '```json' || chr(10) || {_HINT} || chr(10) || '```' ELSE {_HINT} END) AS VARCHAR) || ',"type":"output_text"}}]}}]}},"status_code":500}}' END AS error,
  CASE WHEN doc_id % 3 <> 0 THEN lang END AS concise_hint, CASE WHEN doc_id % 3 <> 0 THEN '["a","b"]' END AS detailed_method_hint FROM documents""")  # fmt: skip
def batch_results(spark, sf):
    d = A.table(spark, sf, "documents", "doc_id", "lang")
    hint = F.to_json(F.struct(F.concat(F.lit(" "), "lang").alias("concise_hint"), F.lit("a\n\n b ").alias("detailed_method_hint"), F.array(F.lit("x "), F.lit("")).alias("detailed_scaffold_hint")))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), hint, F.lit("\n```"))).otherwise(hint)
    body = F.struct(F.array(F.struct(F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content"))).alias("output"))
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(F.when(F.col("doc_id") % 3 == 0, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response")))
    out = checkpoints.parse_results(d.select(F.parse_json(row).alias("_v")))
    return out.select(F.col("index").cast("long").alias("doc_id"), "status", "error", "concise_hint", "detailed_method_hint")


@query("""WITH RECURSIVE e AS (SELECT user_id, value > 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  f AS (SELECT user_id, 1 AS correct, 0 AS errors, 0 AS steps, 'open' AS state FROM (SELECT DISTINCT user_id FROM e)
    UNION ALL SELECT f.user_id, CASE WHEN e.ok THEN f.correct + 1 ELSE 0 END, CASE WHEN e.ok THEN 0 ELSE f.errors + 1 END, f.steps + 1,
      CASE WHEN e.ok AND f.correct + 1 >= 5 THEN 'solved' WHEN NOT e.ok AND f.errors + 1 >= 10 THEN 'failed' ELSE 'open' END
    FROM f JOIN e ON f.user_id = e.user_id AND e.n = f.steps + 1 WHERE f.state = 'open' AND f.steps < 30)
  SELECT user_id, correct, errors, steps, state FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY steps DESC) = 1""")  # fmt: skip
def verdict_fold(spark, sf):
    e = A.table(spark, sf, "events", "event_id", "ts", "user_id", "value")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 50).alias("ok"))))
    folded = e.groupBy("user_id").agg(checkpoints.verdict_fold(F.transform(ordered, lambda x: x["ok"])).alias("f"))
    return folded.select("user_id", "f.correct", "f.errors", "f.steps", "f.state")
