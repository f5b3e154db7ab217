"""Adapters from the driver's tables to the reference's shapes.

Each adapter is a Spark plan over a given table, so its work grows with the
table.  The same rules are written in DuckDB SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from askbase.session import read_table

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

Q_TEXT_SQL = """
case p_partkey % 8
  when 0 then p_name
  when 1 then concat(substr(p_name, instr(p_name, ' ') + 1), ' ', substr(p_name, 1, instr(p_name, ' ') - 1))
  when 2 then concat(upper(p_name), '?')
  when 3 then substr(p_name, 3)
  when 4 then concat(p_name, ' !! lutfen')
  when 5 then concat(substr(p_name, 1, 4), ' nedir acaba')
  when 6 then concat('zzq ', p_brand)
  else case ((p_partkey - p_partkey % 8) div 8) % 5
    when 0 then 'bugün yemekte ne var'
    when 1 then 'bugünün tarihi'
    when 2 then 'yarın saat kaç'
    when 3 then 'bugün günlerden ne'
    else 'yarın hangi gün' end
end
"""

# The service clock of a question: a fixed start plus 3607 s per question id,
# so answers cross day, month and year ends.
AS_OF_SQL = "timestampadd(SECOND, p_partkey * 3607, TIMESTAMP_NTZ '2024-01-01 08:30:00')"
# A page snapshot per calendar day for the meal route.
MENU_DATE_SQL = "date_add(DATE '2024-01-01', CAST(page_id AS INT))"


def kb_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KB: one intent per part type; sorted distinct names and brands."""
    part = read_table(spark, sf_dir, "part")
    g = part.groupBy(F.col("p_type").alias("tag")).agg(
        F.sort_array(F.collect_set("p_name")).alias("patterns"),
        F.sort_array(F.collect_set("p_brand")).alias("responses"))
    from askbase.operators.indexing import dense_index
    return dense_index(g, [F.col("tag")], "intent_pos").select(
        F.col("intent_pos").cast("int").alias("intent_pos"), "tag", "patterns", "responses",
        F.lit("").alias("context_set"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q: question_id, text, as_of."""
    part = read_table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("question_id"), F.expr(Q_TEXT_SQL).alias("text"),
                       F.expr(AS_OF_SQL).alias("as_of"))


def menu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MENU: every page with its navigation list as a menu table, written in one
    of four ways: a class among others, a bare class in capitals, behind an old
    table in a comment, and with a table inside a cell."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    nav = F.regexp_extract("html", r"(?s)<nav><ul>(.*?)</ul></nav>", 1)
    rows = F.regexp_replace(nav, r'<li><a href="([^"]*)">(.*?)</a></li>',
                            "<tr><td>$1</td><td> <b>$2</b> &ccedil;&#252;&#x131; </td></tr>")
    kind = F.col("page_id") % 4
    table = (F.when(kind == 0, F.concat(F.lit('<table class="x has-background">'), rows, F.lit("</table>")))
             .when(kind == 1, F.concat(F.lit("<TABLE id=m class=has-background>"), rows, F.lit("</TABLE>")))
             .when(kind == 2, F.concat(F.lit('<!-- <table class="has-background"><tr><td>a</td><td>b</td></tr></table> -->'
                                             '<table class="has-background">'), rows, F.lit("</table>")))
             .otherwise(F.concat(F.lit("<table class='has-background y'><tr><td>G</td><td><table><tr><td>i</td><td>&Ouml;"
                                       "</td></tr></table></td></tr>"), rows, F.lit("</table>"))))
    return p.select("page_id", F.replace("html", F.concat(F.lit("<nav><ul>"), nav, F.lit("</ul></nav>")), table).alias("html"))


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu page snapshots keyed by day, answered by H5."""
    from askbase.operators.menu import daily_menu
    # reading a page takes milliseconds, and a file of few row groups gives few tasks
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = menu_pages(spark, sf_dir).repartition(tasks)
    return daily_menu(pages).select(F.expr(MENU_DATE_SQL).alias("menu_date"), "menu")


# Classes that PRED guesses among; the knowledge base has fewer tags, so some
# guesses have no label.
PRED_CLASSES = 10


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRED: vec_id, label, pred (position of the largest value, modulo the classes)."""
    e = read_table(spark, sf_dir, "embeddings")
    x = F.col("embedding")
    return e.select("vec_id", "label", ((F.array_position(x, F.array_max(x)) - 1) % PRED_CLASSES).cast("int").alias("pred"))


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: vec_id, logits (the values as double)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("logits"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQ: request bodies, some empty, null-valued or broken."""
    ev = read_table(spark, sf_dir, "events")
    r = F.col("event_id") % 10
    body = (F.when(r == 7, F.lit("{}"))
            .when(r == 8, F.lit('{"question": null}'))
            .when(r == 9, F.lit('{"question": '))
            .otherwise(F.concat(F.lit('{"question": "'), F.col("event_type"), F.lit('"}'))))
    return ev.select("event_id", F.col("user_id").alias("chat_id"), "ts", body.alias("body"))


def as_messages(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as chat messages: some echo commands, some without text."""
    r = F.col("event_id") % 5
    text = (F.when(r == 0, F.concat(F.lit("/echo "), F.col("event_type")))
            .when(r == 1, F.lit(None).cast("string"))
            .when(r == 2, F.lit("hey /echo a\nb"))
            .otherwise(F.col("event_type")))
    return events.select("event_id", F.col("user_id").alias("chat_id"), "ts", text.alias("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSG: chat messages."""
    return as_messages(read_table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The events below ``path`` as an unbounded source of files."""
    return spark.readStream.schema(EVENTS_SCHEMA).options(**options).parquet(path)


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSG as an unbounded source: the events table read as a file stream."""
    return as_messages(event_stream(spark, sf_dir, pathGlobFilter="events.parquet"))


def as_bodies(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as request bodies: echo commands, questions, and
    bodies that are empty, null-valued or broken."""
    r = F.col("event_id") % 10
    body = (F.when(r == 7, F.lit("{}"))
            .when(r == 8, F.lit('{"question": null}'))
            .when(r == 9, F.lit('{"question": '))
            .when(r % 5 == 0, F.concat(F.lit('{"question": "/echo '), F.col("event_type"), F.lit('"}')))
            .otherwise(F.concat(F.lit('{"question": "'), F.col("event_type"), F.lit('"}'))))
    return events.select("event_id", F.col("user_id").alias("chat_id"), "ts", body.alias("body"))


def as_utterances(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as speech transcripts: partial results and finals."""
    return events.select(F.col("user_id").alias("utterance_id"), F.col("event_id").alias("seq"), "ts",
                         (F.col("event_type") == "purchase").alias("is_final"), F.col("event_type").alias("text"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHAT: conversations, assistant = bot."""
    c = read_table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "assistant", F.lit("bot")).otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), "text")


def chat_class():
    """A class per role of CHAT: user 0, bot 1, others 2."""
    return F.when(F.col("role") == "user", 0).when(F.col("role") == "bot", 1).otherwise(2).cast("int")


def blank_turns(chat_df: DataFrame) -> DataFrame:
    """F4's input: the text of every 5th turn is blank."""
    return chat_df.withColumn("text", F.when(F.col("turn") % 5 == 4, F.lit("")).otherwise(F.col("text")))


def fixture_predict(labels: DataFrame, seed: str = "7") -> Callable[[DataFrame], DataFrame]:
    """Deterministic class scores of a model with ``labels``: id = md5(seed:question_id)
    mod (num_labels+1); the extra id is not in the table and decodes to ``unseen_tag``."""
    from askbase.operators.answer import md5_bucket
    from askbase.operators.labels import decoded
    n = labels.count()

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("pred_id", F.pmod(md5_bucket(F.lit(seed), F.col("question_id")), F.lit(n + 1))
                             .cast("int"))
    return decoded(predict, labels)


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules table: a piece of every part name, one to twelve letters from one of its first
    four, for one of two profiles; the part is the priority and its type the route."""
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    piece = F.lower(F.substring("p_name", (key % 4 + 1).cast("int"), (key % 12 + 1).cast("int")))
    return p.select(F.when(key % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("profile"), key.cast("int").alias("priority"),
                    F.col("p_type").alias("route"), piece.alias("phrase"))


def many_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A knowledge base of one intent per type whose patterns are all its distinct (name, brand, size)
    texts, and questions that are such texts of other parts, changed."""
    p = read_table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", F.lower("p_brand"), F.concat(F.lit("s"), F.col("p_size")))
    from askbase.operators.indexing import dense_index
    g = p.filter(F.col("p_partkey") % 2 == 0).groupBy(F.col("p_type").alias("tag")).agg(F.sort_array(F.collect_set(text)).alias("patterns"))
    intents = dense_index(g, [F.col("tag")], "intent_pos").select(
        F.col("intent_pos").cast("int").alias("intent_pos"), "tag", "patterns", F.array(F.lit("x")).alias("responses"), F.lit("").alias("context_set"))
    k = F.col("p_partkey") % 6
    asked = (F.when(k == 1, F.reverse(text)).when(k == 3, F.concat(text, F.lit(" nedir acaba"))).otherwise(F.md5(text)))
    return intents, p.filter(F.col("p_partkey") % 2 == 1).select(F.col("p_partkey").alias("question_id"), asked.alias("text"))


def drifted_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KB some time after training: a tag new at the front, the third one gone."""
    kb = kb_intents(spark, sf_dir)
    new = kb.filter(F.col("intent_pos") == 0).withColumn("tag", F.lit("AAA NEW"))
    old = kb.filter(F.col("intent_pos") != 2).withColumn("intent_pos", (F.col("intent_pos") + 1).cast("int"))
    return new.unionByName(old)


def unknown_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of Q the web answer flow cannot answer: question_id, text."""
    from askbase.operators.answer import answer_questions
    from askbase.operators.knowledge import KnowledgeBase
    from askbase.operators.routing import WEB
    kb = KnowledgeBase(kb_intents(spark, sf_dir))
    ans = answer_questions(questions(spark, sf_dir), kb, WEB, predict=fixture_predict(kb.labels),
                           menus=menus(spark, sf_dir), carry=("text",))
    return ans.filter(F.col("is_unknown")).select("question_id", "text")


def unknown_table(spark: SparkSession, sf_dir: str, unknown: DataFrame | None = None) -> DataFrame:
    """UNK: the distinct unknown texts, dense ids by first question id,
    answer = brand of that part, null when the id is even, '' when it is a
    multiple of 5."""
    from askbase.operators.indexing import dense_index
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), "p_brand")
    if unknown is None:
        unknown = unknown_questions(spark, sf_dir)
    q = unknown.join(part, "question_id")
    first = q.groupBy("text").agg(F.min_by(F.struct("question_id", "p_brand"), "question_id").alias("f"))
    ids = dense_index(first.select("text", F.col("f.question_id").alias("fq"), F.col("f.p_brand").alias("brand")),
                      [F.col("fq"), F.col("text")], "id", start=1)
    ans = (F.when(F.col("id") % 2 == 0, F.lit(None).cast("string"))
           .when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.col("brand")))
    return ids.select(F.col("id").cast("bigint").alias("id"), F.col("text").alias("question"), ans.alias("answer"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation history: step = event_id, loss = value."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("step"), F.col("value").alias("loss"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech transcripts: partial results and finals per utterance."""
    return as_utterances(read_table(spark, sf_dir, "events")).drop("ts")
