"""DuckDB SQL for every SQL-checkable query (the correctness oracle).

The oracle restates each operator's result in plain SQL over the same
parquet tables, independently of the Spark plan: no pruning, no bitmasks;
the similarity score is the textbook LCS dynamic programme written as
nested ``list_reduce``.  Fragment builders keep the long expressions in one
place; ``with_ctes`` pulls in the common table expressions a query needs.
"""

from __future__ import annotations

from askbase import constants as K

# ------------------------------------------------------------------ fragments


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def key(x: str) -> str:
    """T2 token-sort key."""
    return (r"array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace("
            r"regexp_replace(" + x + r", '[\x{80}-\x{ff}]', '', 'g'), '[^\p{L}\p{N}_]', ' ', 'g'))), ' '), "
            r"lambda t: t <> '')), ' ')")


def lcs(a: str, b: str) -> str:
    """Textbook LCS table, one row per character of ``a``."""
    return (f"list_reduce(string_split({a}, ''), lambda prev, ca: list_reduce(range(1, length({b}) + 1), "
            f"lambda cur, j: list_append(cur, CASE WHEN ca = substr({b}, j::INTEGER, 1) THEN prev[j] + 1 "
            f"ELSE greatest(prev[j + 1], cur[j]) END), [0]), list_resize([0], length({b}) + 1, 0))"
            f"[length({b}) + 1]")


def ratio(m: str, t: str) -> str:
    return f"round_even(100::DOUBLE * ((2::DOUBLE * ({m})) / ({t})::DOUBLE), 0)::INTEGER"


def score(q: str, p: str) -> str:
    """M1 with the matcher's edge cases."""
    return (f"CASE WHEN {q} = {p} THEN 100 WHEN length({q}) = 0 OR length({p}) = 0 THEN 0 "
            f"ELSE {ratio(lcs(q, p), f'length({q}) + length({p})')} END")


def contains_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in phrases) + ")"


def route(tl: str, profile: str = "web") -> str:
    meal = K.MEAL_PHRASES_WEB if profile == "web" else K.MEAL_PHRASES_LOCAL
    rules = [(K.ROUTE_MEAL, meal), (K.ROUTE_DATE, K.DATE_PHRASES), (K.ROUTE_TIME, K.TIME_PHRASES),
             (K.ROUTE_WEEKDAY, K.WEEKDAY_PHRASES), (K.ROUTE_TOMORROW, K.TOMORROW_PHRASES)]
    return "CASE " + " ".join(f"WHEN {contains_any(tl, ph)} THEN {lit(r)}" for r, ph in rules) + " END"


BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def month_tr(m: str) -> str:
    return "([" + ", ".join(lit(n) for n in K.MONTH_NAMES_TR) + f"])[{m}]"


def day_tr(d: str) -> str:
    return "CASE " + " ".join(f"WHEN {d} = {lit(k)} THEN {lit(v)}" for k, v in K.DAY_NAMES_TR.items()) + f" ELSE {d} END"


def date_words(ts: str) -> str:
    return (f"strftime({ts}, '%d'), {month_tr(f'month({ts})')}, strftime({ts}, '%Y'), "
            f"{day_tr(f'dayname({ts})')}")


def today(ts: str) -> str:
    return f"concat_ws(' ', 'Bugün', {date_words(ts)})"


def tomorrow(ts: str) -> str:
    d = f"(CAST({ts} AS DATE) + 1)"
    return f"concat_ws(' ', 'Yarın', {date_words(d)})"


def time_str(ts: str) -> str:
    return f"strftime({ts}, '%H:%M:%S')"


def md5_bucket(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


def trim_hf(rows: str) -> str:
    return f"{rows}[2:greatest(len({rows}) - 1, 1)]"


def menu_text(rows: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda r: concat(r[1], ': ', r[2])), chr(10))"


# ------------------------------------------------------------------- CTEs

Q_TEXT = """CASE p_partkey % 8
  WHEN 0 THEN p_name
  WHEN 1 THEN concat(substr(p_name, instr(p_name, ' ') + 1), ' ', substr(p_name, 1, instr(p_name, ' ') - 1))
  WHEN 2 THEN concat(upper(p_name), '?')
  WHEN 3 THEN substr(p_name, 3)
  WHEN 4 THEN concat(p_name, ' !! lutfen')
  WHEN 5 THEN concat(substr(p_name, 1, 4), ' nedir acaba')
  WHEN 6 THEN concat('zzq ', p_brand)
  ELSE CASE (((p_partkey - p_partkey % 8) // 8) % 5)
    WHEN 0 THEN 'bugün yemekte ne var'
    WHEN 1 THEN 'bugünün tarihi'
    WHEN 2 THEN 'yarın saat kaç'
    WHEN 3 THEN 'bugün günlerden ne'
    ELSE 'yarın hangi gün' END
END"""

NAV_LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'

CTES: dict[str, tuple[list[str], str]] = {
    "kb": ([], """SELECT (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS intent_pos, p_type AS tag,
  list_sort(list_distinct(list(p_name))) AS patterns, list_sort(list_distinct(list(p_brand))) AS responses,
  '' AS context_set FROM part GROUP BY p_type"""),
    "qa_p": (["kb"], """SELECT intent_pos, tag, patterns, responses,
  unnest(range(len(patterns)))::INTEGER AS pattern_pos FROM kb"""),
    "qa": (["qa_p"], """SELECT patterns[pattern_pos + 1] AS "Pattern", tag AS "Tag",
  responses[response_pos + 1] AS "Response", intent_pos, pattern_pos, response_pos
  FROM (SELECT *, unnest(range(len(responses)))::INTEGER AS response_pos FROM qa_p)"""),
    "q": ([], f"""SELECT p_partkey AS question_id, {Q_TEXT} AS text,
  TIMESTAMP '2024-01-01 08:30:00' + to_seconds(p_partkey * 3607) AS as_of FROM part"""),
    "tags": (["qa"], """SELECT "Tag" AS tag, min(intent_pos) AS first_intent FROM qa GROUP BY "Tag" """),
    "labels": (["tags"], f"""SELECT (row_number() OVER (ORDER BY first_intent) - 1)::INTEGER AS label_id, tag,
  {strip('tag')} AS label FROM tags"""),
    "tag_counts": (["qa"], """SELECT "Tag" AS tag, count(*) AS n_rows FROM qa GROUP BY "Tag" """),
    "qa_ord": (["qa"], """SELECT "Tag" AS tag, row_number() OVER (PARTITION BY "Tag"
  ORDER BY intent_pos, pattern_pos, response_pos) - 1 AS ord, "Response" AS response FROM qa"""),
    "pk": (["qa"], f"""SELECT DISTINCT {key('lower("Pattern")')} AS pkey FROM qa"""),
    # the menu rows straight from the links that MENU puts into its table
    "nav": ([], """SELECT page_id, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1) AS nav FROM pages"""),
    "menu_rows": (["nav"], f"""SELECT page_id, list_concat(CASE WHEN page_id % 4 = 3
  THEN [['G', 'iÖ', 'i', 'Ö'], ['i', 'Ö']] ELSE [] END, list_transform(regexp_extract_all(nav, '{NAV_LINK}', 0),
  lambda r: [regexp_extract(r, '{NAV_LINK}', 1), regexp_extract(r, '{NAV_LINK}', 2) || ' çüı'])) AS rws FROM nav"""),
    "menu_box": (["nav"], f"""SELECT page_id, concat(CASE WHEN page_id % 4 = 3 THEN '<tr><td>G</td><td><table><tr><td>i</td>'
  || '<td>&Ouml;</td></tr></table></td></tr>' ELSE '' END, array_to_string(list_transform(
  regexp_extract_all(nav, '{NAV_LINK}', 0), lambda r: concat('<tr><td>', regexp_extract(r, '{NAV_LINK}', 1), '</td><td> <b>',
  regexp_extract(r, '{NAV_LINK}', 2), '</b> &ccedil;&#252;&#x131; </td></tr>')), '')) AS box FROM nav"""),
    "menus": (["menu_rows"], f"""SELECT DATE '2024-01-01' + page_id::INTEGER AS menu_date,
  {menu_text(trim_hf('rws'))} AS menu FROM menu_rows"""),
}


def with_ctes(needed: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in (extra or [])]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# ---------------------------------------------------------------- more CTEs

CTES.update({
    "chat": ([], """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'bot' ELSE role END AS role,
  text FROM conversations"""),
    "pred": ([], """SELECT vec_id, label, ((list_position(embedding, list_max(embedding)) - 1) % 10)::INTEGER
  AS pred FROM embeddings"""),
    "vec": ([], """SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS logits FROM embeddings"""),
    "req": ([], """SELECT event_id, user_id AS chat_id, ts, CASE event_id % 10 WHEN 7 THEN '{}'
  WHEN 8 THEN '{"question": null}' WHEN 9 THEN '{"question": ' ELSE concat('{"question": "', event_type, '"}') END
  AS body FROM events"""),
    "msg": ([], """SELECT event_id, user_id AS chat_id, ts, CASE event_id % 5 WHEN 0 THEN concat('/echo ', event_type)
  WHEN 1 THEN NULL WHEN 2 THEN concat('hey /echo a', chr(10), 'b') ELSE event_type END AS text FROM events"""),
    "unk_q": (["ans_q"], """SELECT q.question_id, q.text FROM ans_q a JOIN q USING (question_id)
  WHERE a.is_unknown"""),
    "unk": (["unk_q"], """SELECT id::BIGINT AS id, text AS question,
  CASE WHEN id % 2 = 0 THEN NULL WHEN id % 5 = 0 THEN '' ELSE fb END AS answer
  FROM (SELECT row_number() OVER (ORDER BY fq, text) AS id, text, fb FROM (
    SELECT u.text, min(u.question_id) AS fq, arg_min(p.p_brand, u.question_id) AS fb
    FROM unk_q u JOIN part p ON p.p_partkey = u.question_id GROUP BY u.text))"""),
    "utter": ([], """SELECT user_id AS utterance_id, event_id AS seq, event_type = 'purchase' AS is_final,
  event_type AS text FROM events"""),
    "pred_tags": (["pred", "labels"], """SELECT pred.vec_id, pred.label, pred.pred AS pred_id,
  coalesce(labels.label, 'unseen_tag') AS pred_tag FROM pred LEFT JOIN labels ON labels.label_id = pred.pred"""),
    "export": (["unk"], """SELECT (id - 1)::INTEGER AS intent_pos, 'custom_tag' AS tag, [question] AS patterns,
  [CASE WHEN answer IS NULL OR answer = '' THEN '' ELSE answer END] AS responses, '' AS context_set FROM unk"""),
    "pk2": (["qa"], f"""SELECT pkey, arg_min("Pattern", pos) AS first_pattern, min(pos) AS first_pos FROM
  (SELECT {key('lower("Pattern")')} AS pkey, "Pattern", intent_pos::BIGINT * 1000000 + pattern_pos AS pos FROM qa)
  GROUP BY pkey"""),
    "tokens": (["chat"], r"""SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text),
  '[\p{L}\p{N}_]+|[^\s\x{0B}\p{Z}\p{L}\p{N}_]', 0), lambda t: NOT list_contains(['?', '!', ',', '.'], t)) AS toks
  FROM chat"""),
})


def _register_answer_ctes():
    prev = ANSWER_BASE + ["q"]
    for name, sql in answer_ctes("q", "web", tag="_q"):
        CTES[name] = (list(prev), sql)
        prev = [name]


def flatten_sql(src: str) -> str:
    """P1 over an intents relation named ``src``."""
    return f"""SELECT patterns[pattern_pos + 1] AS "Pattern", tag AS "Tag", responses[response_pos + 1] AS "Response",
  intent_pos, pattern_pos, response_pos FROM (
    SELECT *, unnest(range(len(responses)))::INTEGER AS response_pos FROM (
      SELECT *, unnest(range(len(patterns)))::INTEGER AS pattern_pos FROM {src}))"""


def answer_ctes(src: str, profile: str = "web", tag: str = "") -> list[tuple[str, str]]:
    """J6 over a relation ``src`` (question_id, text, as_of); last CTE: ans{tag}."""
    thr = K.THRESHOLD_WEB if profile == "web" else K.THRESHOLD_LOCAL
    t = tag
    routed = route("lower(coalesce(text, ''))", profile)
    return [
        (f"qr{t}", f"SELECT question_id, coalesce(text, '') AS text, as_of, "
                   f"{routed} AS route FROM {src}"),
        (f"qk{t}", f"SELECT DISTINCT {key('lower(text)')} AS qkey FROM qr{t} WHERE route IS NULL"),
        (f"passed{t}", f"SELECT qkey FROM qk{t} WHERE EXISTS (SELECT 1 FROM pk WHERE {score('qkey', 'pkey')} >= {thr})"),
        (f"g{t}", f"""SELECT qr{t}.*, CASE WHEN route IS NULL THEN EXISTS (SELECT 1 FROM passed{t}
              WHERE passed{t}.qkey = {key(f'lower(qr{t}.text)')}) END AS gate_passed FROM qr{t}"""),
        (f"p{t}", f"""SELECT g{t}.*, CASE WHEN gate_passed THEN coalesce(l.label, 'unseen_tag') END AS pred_tag
              FROM g{t} LEFT JOIN labels l ON l.label_id =
              {md5_bucket("'7'", f'CAST(g{t}.question_id AS VARCHAR)')} % ((SELECT count(*) FROM labels) + 1)"""),
        (f"c{t}", f"""SELECT p{t}.*, tc.n_rows, o.response FROM p{t}
              LEFT JOIN tag_counts tc ON tc.tag = p{t}.pred_tag
              LEFT JOIN qa_ord o ON o.tag = p{t}.pred_tag
               AND o.ord = {md5_bucket("'42'", f'CAST(p{t}.question_id AS VARCHAR)')} % tc.n_rows"""),
        (f"r{t}", f"""SELECT c{t}.*, CASE WHEN route IS NOT NULL THEN NULL WHEN NOT gate_passed THEN 'no_match'
              WHEN n_rows IS NULL THEN 'unknown_tag' WHEN n_rows = 0 THEN 'no_response' END AS reason,
              m.menu FROM c{t} LEFT JOIN menus m ON m.menu_date = CAST(c{t}.as_of AS DATE)"""),
        (f"ans{t}", f"""SELECT question_id, route, gate_passed, pred_tag AS tag,
  CASE WHEN route = 'meal' THEN coalesce(menu, {lit(K.MENU_UNAVAILABLE)})
       WHEN route = 'date' THEN {today('as_of')}
       WHEN route = 'time' THEN {time_str('as_of')}
       WHEN route = 'weekday' THEN {today('as_of')} || '.'
       WHEN route = 'tomorrow' THEN {tomorrow('as_of')}
       WHEN reason IS NOT NULL THEN {lit(K.FALLBACK_ANSWER)}
       ELSE response END AS answer,
  reason IS NOT NULL AS is_unknown, reason FROM r{t}"""),
    ]


ANSWER_BASE = ["labels", "tag_counts", "qa_ord", "pk", "menus"]
_register_answer_ctes()


def answer_sql(src_cte: str, body: str, profile: str = "web", extra_src=None) -> str:
    needed = ANSWER_BASE + ([src_cte] if src_cte in CTES else [])
    return with_ctes(needed, body, (extra_src or []) + answer_ctes(src_cte, profile))


def drifted_answer_sql() -> str:
    """J6 over a KB that has a new first tag and lacks the third one; class ids
    keep the meaning they have in the label table of the original KB."""
    kb2 = """SELECT 0 AS intent_pos, 'AAA NEW' AS tag, patterns, responses FROM kb WHERE intent_pos = 0
  UNION ALL SELECT intent_pos + 1, tag, patterns, responses FROM kb WHERE intent_pos <> 2"""
    later = [("kb2", kb2), ("qa2", flatten_sql("kb2"))]
    for name in ("tag_counts", "qa_ord", "pk"):
        later.append((f"{name}2", CTES[name][1].replace("FROM qa", "FROM qa2")))
    flow = []
    for name, sql in answer_ctes("q"):
        for t in ("tag_counts", "qa_ord"):
            sql = sql.replace(f"JOIN {t} ", f"JOIN {t}2 ")
        flow.append((name, sql.replace("FROM pk ", "FROM pk2 ")))
    return with_ctes(["labels", "menus", "q"], "SELECT * FROM ans", later + flow)


def cells_explode(rows_expr: str, src: str) -> str:
    return f"""SELECT page_id, row_pos, (cell_pos - 1)::INTEGER AS cell_pos, cells[cell_pos] AS cell FROM (
  SELECT page_id, row_pos, cells, unnest(range(1, len(cells) + 1)) AS cell_pos FROM (
    SELECT page_id, (row_pos - 1)::INTEGER AS row_pos, rws[row_pos] AS cells FROM (
      SELECT page_id, rws, unnest(range(1, len(rws) + 1)) AS row_pos FROM (
        SELECT page_id, {rows_expr} AS rws FROM {src}))))"""


def _intents_scalar(src: str) -> str:
    return (f"SELECT intent_pos, tag, array_to_string(patterns, '|') AS patterns, "
            f"array_to_string(responses, '|') AS responses, context_set FROM {src}")


def _req_parsed() -> tuple[str, str]:
    return ("reqp", """SELECT event_id, chat_id, ts,
  CASE WHEN NOT json_valid(body) THEN NULL WHEN NOT list_contains(json_keys(body), 'question') THEN ''
       ELSE json_extract_string(body, '$.question') END AS question,
  CASE WHEN NOT json_valid(body) THEN 'malformed request'
       WHEN list_contains(json_keys(body), 'question') AND json_extract_string(body, '$.question') IS NULL
       THEN 'null question' END AS error FROM req""")


def _plain_sql() -> dict[str, str]:
    qa_cols = 'SELECT "Pattern", "Tag", "Response", intent_pos, pattern_pos, response_pos FROM qa'
    thr = K.THRESHOLD_WEB
    month_names = "[" + ", ".join(lit(n) for n in K.MONTH_NAMES_TR) + "]"
    out = {
        # sources
        "read_intents": with_ctes(["kb"], _intents_scalar("kb")),
        "read_intents_document": with_ctes(["kb"], _intents_scalar("kb")),
        "read_intents_files": with_ctes(["kb"], _intents_scalar("kb")),
        "read_intents_split": with_ctes(["kb"], _intents_scalar("kb")),
        "read_qa_array": with_ctes(["qa"], """SELECT "Pattern", "Tag", "Response", (row_number() OVER (
  PARTITION BY intent_pos ORDER BY pattern_pos, response_pos) - 1)::INTEGER AS record_pos FROM qa"""),
        "write_qa_records": with_ctes(["qa"], qa_cols),
        "read_qa_records": with_ctes(["qa"], qa_cols),
        "scan_unknown": with_ctes(["unk"], "SELECT id, question, answer FROM unk"),
        "export_intents": with_ctes(["export"], _intents_scalar("export")),
        "write_intents": with_ctes(["export"], flatten_sql("export")),
        "append_question_log": with_ctes(["unk_q"], "SELECT text AS \"Question\" FROM unk_q "
                                                   "UNION ALL SELECT text FROM unk_q"),
        "reset_unknown": with_ctes(["unk_q"], """SELECT (row_number() OVER (ORDER BY arrival, question))::BIGINT AS id,
  question, NULL::VARCHAR AS answer FROM (SELECT text AS question, min(question_id) AS arrival FROM unk_q
  GROUP BY text)"""),
        "empty_qa": with_ctes(["qa"], 'SELECT "Pattern", "Tag", "Response" FROM qa'),
        "parse_requests": with_ctes(["req"], "SELECT event_id, chat_id, question, error FROM reqp", [_req_parsed()]),
        "format_replies": answer_sql("q", "SELECT question_id, json_object('answer', answer)::VARCHAR AS reply FROM ans"),
        # reshaping
        "flatten_intents": with_ctes(["qa"], qa_cols),
        "flatten_intents_lenient": with_ctes(["kb"], flatten_sql("kbn"), [
            ("kbn", "SELECT * FROM kb WHERE intent_pos % 3 <> 1")]),
        "append_qa": with_ctes(["qa"], qa_cols),
        "preview": with_ctes(["qa"], qa_cols + " ORDER BY intent_pos, pattern_pos, response_pos LIMIT 5"),
        "pattern_scan": with_ctes(["qa"], 'SELECT lower("Pattern") AS pattern_lower, intent_pos, pattern_pos, '
                                          'response_pos FROM qa'),
        # routing
        "keyword_any": with_ctes(["chat"], "SELECT conv_id, turn, " + ", ".join(
            f"{contains_any('lower(text)', ph)} AS {r}" for r, ph in [
                (K.ROUTE_MEAL, K.MEAL_PHRASES_WEB), (K.ROUTE_DATE, K.DATE_PHRASES), (K.ROUTE_TIME, K.TIME_PHRASES),
                (K.ROUTE_WEEKDAY, K.WEEKDAY_PHRASES), (K.ROUTE_TOMORROW, K.TOMORROW_PHRASES)]) + " FROM chat"),
        "route_intent": with_ctes(["q"], f"SELECT question_id, {route('lower(text)')} AS route FROM q"),
        "route_profiles": with_ctes(["q"], f"""SELECT question_id, 'web' AS profile, {route('lower(text)', 'web')} AS route,
  {K.THRESHOLD_WEB} AS threshold FROM q UNION ALL SELECT question_id, 'local', {route('lower(text)', 'local')},
  {K.THRESHOLD_LOCAL} FROM q"""),
        "route_rules": with_ctes(["q"], """SELECT question_id, profile, arg_min(route, (priority, phrase)) AS route,
  min(priority) AS priority, arg_min(phrase, (priority, phrase)) AS phrase FROM (SELECT question_id, p.profile, priority, route, phrase
  FROM q CROSS JOIN (SELECT DISTINCT profile FROM rules) p LEFT JOIN rules r
  ON r.profile = p.profile AND contains(lower(q.text), r.phrase)) GROUP BY question_id, profile""", [
            ("rules", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, p_partkey::INTEGER AS priority,
  p_type AS route, lower(substr(p_name, (p_partkey % 4 + 1)::INTEGER, (p_partkey % 12 + 1)::INTEGER)) AS phrase FROM part""")]),
        "route_rules_built_in": with_ctes(["q"], f"""SELECT question_id, 'web' AS profile, {route('lower(text)', 'web')} AS route
  FROM q UNION ALL SELECT question_id, 'local', {route('lower(text)', 'local')} FROM q"""),
        "nonempty_input": with_ctes(["chat"], "SELECT * FROM chat WHERE text <> '' AND turn % 5 <> 4"),
        "final_only": with_ctes(["utter"], "SELECT utterance_id, seq, text FROM utter WHERE is_final"),
        "final_only_latest": with_ctes(["utter"], "SELECT utterance_id, arg_max(text, seq) AS text, max(seq) AS seq "
                                                  "FROM utter GROUP BY utterance_id"),
        "command_match": with_ctes(["msg"], "SELECT event_id, chat_id, regexp_extract(text, '/echo (.+)', 1) AS reply "
                                            "FROM msg WHERE regexp_matches(text, '/echo (.+)')"),
        # text
        "casefold_lower": with_ctes(["chat"], "SELECT conv_id, turn, lower(text) AS text_lower FROM chat"),
        "token_sort_key": with_ctes(["chat"], f"SELECT conv_id, turn, {key('text')} AS sort_key FROM chat"),
        "tokenize_clean": with_ctes(["tokens"], "SELECT conv_id, turn, array_to_string(toks, ' ') AS tokens, "
                                                "len(toks)::INTEGER AS n_tokens FROM tokens"),
        "strip_text": with_ctes(["kb"], f"""SELECT intent_pos, raw, {strip('raw')} AS stripped FROM (
  SELECT intent_pos, CASE WHEN intent_pos % 2 = 1 THEN concat(' ' || chr(9), tag, chr(160) || ' ') ELSE tag END AS raw FROM kb)"""),
        "utf8_clean": with_ctes(["chat"], "SELECT conv_id, turn, text AS clean FROM chat"),
        # similarity
        "token_sort_ratio_indel": with_ctes(["q"], f"""SELECT question_id, {score('qk', 'pk')} AS score FROM (
  SELECT q.question_id, {key('lower(q.text)')} AS qk, {key('lower(p.p_name)')} AS pk
  FROM q JOIN part p ON p.p_partkey = q.question_id)"""),
        "fuzzy_gate": with_ctes(["q", "pk"], f"""SELECT question_id, t AS threshold,
  EXISTS (SELECT 1 FROM pk WHERE {score(key('lower(q.text)'), 'pkey')} >= t) AS passed
  FROM q, (VALUES ({K.THRESHOLD_WEB}), ({K.THRESHOLD_LOCAL})) th(t)"""),
        "candidate_prune": with_ctes(["q", "pk"], f"""SELECT qkey, count(*) AS n_candidates FROM
  (SELECT DISTINCT {key('lower(text)')} AS qkey FROM q) qk, pk
  WHERE {ratio('least(length(qkey), length(pkey))', 'length(qkey) + length(pkey)')} >= {thr}
    AND {ratio(bag_common('qkey', 'pkey'), 'length(qkey) + length(pkey)')} >= {thr}
  GROUP BY qkey"""),
        "first_match": with_ctes(["q", "pk2"], f"""SELECT question_id, arg_min(first_pattern, first_pos) AS pattern,
  arg_min(sc, first_pos) AS score FROM (
    SELECT q.question_id, pk2.first_pattern, pk2.first_pos, {score(key('lower(q.text)'), 'pk2.pkey')} AS sc
    FROM q, pk2) WHERE sc >= {thr} GROUP BY question_id"""),
        # lookups
        "tag_known": with_ctes(["pred_tags", "tag_counts"], """SELECT vec_id, pred_tag,
  pred_tag IN (SELECT tag FROM tag_counts) AS known FROM pred_tags"""),
        "responses_for_tag": with_ctes(["pred_tags", "qa"], """SELECT vec_id, pred_tag, "Response" AS response,
  count(*) AS n_rows FROM pred_tags JOIN qa ON qa."Tag" = pred_tags.pred_tag GROUP BY ALL"""),
        "no_response": with_ctes(["kb"], """SELECT DISTINCT tag FROM kbe WHERE tag NOT IN (SELECT "Tag" FROM fl)""", [
            ("kbe", "SELECT * REPLACE (CASE WHEN intent_pos = 2 THEN []::VARCHAR[] ELSE responses END AS responses) FROM kb"),
            ("fl", flatten_sql("kbe"))]),
        "label_encode_join": with_ctes(["qa", "labels"], f"""SELECT qa.*, l.labels FROM qa LEFT JOIN
  (SELECT label, max(label_id) AS labels FROM labels GROUP BY label) l ON l.label = {strip('qa."Tag"')}"""),
        "label_decode": with_ctes(["vec", "labels"], """SELECT vec_id, pred_id, coalesce(label, 'unseen_tag') AS pred_tag
  FROM (SELECT vec_id, ((list_position(logits, list_max(logits)) - 1) % 10)::INTEGER AS pred_id FROM vec) v
  LEFT JOIN labels ON labels.label_id = v.pred_id"""),
        "answer_questions": answer_sql("q", "SELECT * FROM ans"),
        "answer_questions_drifted": drifted_answer_sql(),
        "extended_labels": with_ctes(["labels"], """SELECT label_id, tag, label, label_id AS label2id,
  (count(*) OVER ())::INTEGER AS num_labels, since FROM (SELECT label_id, tag, label, 1 AS since FROM labels
  UNION ALL SELECT count(*)::INTEGER, 'AAA NEW', 'AAA NEW', 2 FROM labels)"""),
        "answer_questions_ungated": with_ctes(["labels", "tag_counts", "qa_ord", "q"], f"""SELECT question_id, route,
  gate_passed, pred_tag AS tag, CASE WHEN reason IS NULL THEN response ELSE {lit(K.FALLBACK_ANSWER)} END AS answer,
  reason IS NOT NULL AS is_unknown, reason FROM (SELECT *, CASE WHEN n_rows IS NULL THEN 'unknown_tag' END AS reason
  FROM cu)""", [("gu", "SELECT question_id, NULL::VARCHAR AS route, true AS gate_passed FROM q")]
            + [(n, sql.replace("p_u", "pu")) for n, sql in answer_ctes("q", tag="u") if n in ("pu", "cu")]),
        "answer_questions_local": answer_sql("q", "SELECT * FROM ans", "local"),
        # aggregates
        "distinct_tags": with_ctes(["qa"], """SELECT "Tag" AS tag, first.i AS first_intent_pos, first.p AS first_pattern_pos,
  first.r AS first_response_pos FROM (SELECT "Tag", min({'i': intent_pos, 'p': pattern_pos, 'r': response_pos}) AS first
  FROM qa GROUP BY "Tag")"""),
        "label_index": with_ctes(["labels"], """SELECT label_id, tag, label, max(label_id) OVER (PARTITION BY label)
  AS label2id, (count(*) OVER ())::INTEGER AS num_labels FROM labels"""),
        "accuracy": with_ctes(["pred"], "SELECT round(avg((label = pred)::INTEGER::DOUBLE), 9) AS \"Accuracy\" FROM pred"),
        "macro_prf": with_ctes(["pred"], """SELECT round(sum(tp)::DOUBLE / sum(tp + fn), 9) AS "Accuracy",
  round(avg(f1), 9) AS "F1", round(avg(pr), 9) AS "Precision", round(avg(rc), 9) AS "Recall" FROM (
  SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM (
    SELECT cls, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM (
      SELECT cls, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM (
        SELECT label AS cls, (label = pred)::INTEGER AS tp, 0 AS fp, (label <> pred)::INTEGER AS fn FROM pred
        UNION ALL SELECT pred, 0, (label <> pred)::INTEGER, 0 FROM pred) GROUP BY cls)))"""),
        "confusion_counts": with_ctes(["pred"], "SELECT label, pred, count(*) AS n FROM pred GROUP BY label, pred"),
        "best_checkpoint": """SELECT arg_min(event_id, (value, event_id)) AS step, min(value) AS loss
  FROM events WHERE event_id % 50 = 0""",
        "choose_response": with_ctes(["pred_tags", "tag_counts", "qa_ord"], f"""SELECT p.vec_id, p.pred_tag, o.response
  FROM pred_tags p LEFT JOIN tag_counts tc ON tc.tag = p.pred_tag LEFT JOIN qa_ord o ON o.tag = p.pred_tag
  AND o.ord = {md5_bucket("'42'", 'CAST(p.vec_id AS VARCHAR)')} % tc.n_rows"""),
        "train_test_split": with_ctes(["chat"], f"""SELECT conv_id, turn, CASE WHEN rn < ceil(0.25 * n) THEN 'test'
  ELSE 'train' END AS split FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY h, k) - 1 AS rn,
  count(*) OVER () AS n FROM (SELECT conv_id, turn, concat_ws(':', conv_id, turn) AS k,
  {md5_bucket("'123'", "concat_ws(':', conv_id, turn)")} AS h FROM chat))"""),
        "train_test_split_scale": with_ctes(["chat"], f"""SELECT conv_id, turn,
  CASE WHEN {md5_bucket("'123'", "concat_ws(':', conv_id, turn)")} < {int(0.25 * (1 << 32))} THEN 'test'
  ELSE 'train' END AS split FROM chat"""),
        "split_leakage": with_ctes(["qa"], f"""SELECT count(*) AS n_test,
  count(*) FILTER (WHERE "Pattern" IN (SELECT "Pattern" FROM s WHERE split = 'train')) AS n_leaked
  FROM s WHERE split = 'test'""", [("s", f"""SELECT "Pattern", CASE WHEN rn < ceil(0.25 * n) THEN 'test'
  ELSE 'train' END AS split FROM (SELECT "Pattern", row_number() OVER (ORDER BY h, k) - 1 AS rn,
  count(*) OVER () AS n FROM (SELECT "Pattern", concat_ws(':', intent_pos, pattern_pos, response_pos) AS k,
  {md5_bucket("'123'", "concat_ws(':', intent_pos, pattern_pos, response_pos)")} AS h FROM qa))""")]),
        "chat_latest_first": with_ctes(["chat"], """SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id
  ORDER BY turn DESC) - 1)::INTEGER AS display_pos FROM chat"""),
        # classification
        "softmax_scores": with_ctes(["vec"], """SELECT vec_id, (class_id - 1)::INTEGER AS class_id,
  round(ex[class_id] / list_reduce(ex, lambda a, b: a + b), 9) AS prob FROM (
    SELECT vec_id, ex, unnest(range(1, len(ex) + 1)) AS class_id FROM (
      SELECT vec_id, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM vec))"""),
        "argmax_label": with_ctes(["vec"], """SELECT vec_id, (list_position(logits, list_max(logits)) - 1)::INTEGER
  AS pred_id FROM vec"""),
        "score_batch": with_ctes(["vec", "pred"], """SELECT vec_id, (list_position(sc, list_max(sc)) - 1)::INTEGER AS pred_id,
  round(list_max(sc), 6) AS best_score FROM (
    SELECT vec_id, list_transform(w, lambda row: list_reduce(list_transform(range(1, len(logits) + 1),
      lambda i: logits[i] * row[i]), lambda a, b: a + b, 0.0::DOUBLE)) AS sc FROM vec,
    (SELECT list(c ORDER BY label) AS w FROM (
       SELECT label, list(m ORDER BY d) AS c FROM (
         SELECT label, d, avg(logits[d]) AS m FROM (
           SELECT vec.logits, pred.label, unnest(range(1, 65)) AS d FROM vec JOIN pred USING (vec_id))
         GROUP BY label, d) GROUP BY label)))"""),
        # dates
        "tr_month_name": f"SELECT event_id, {month_names}[month(ts)] AS month_name FROM events",
        "tr_day_name": f"""SELECT event_id, {day_tr('d')} AS day_name FROM (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'Funday' ELSE dayname(ts) END AS d FROM events)""",
        "today_sentence": f"SELECT event_id, {today('ts')} AS sentence FROM events",
        "weekday_sentence": f"SELECT event_id, {today('ts')} || '.' AS sentence FROM events",
        "tomorrow_sentence": f"SELECT event_id, {tomorrow('ts')} AS sentence FROM events",
        "time_string": f"SELECT event_id, {time_str('ts')} AS time FROM events",
        # html
        "html_container": with_ctes(["menu_box"], "SELECT page_id, box FROM menu_box"),
        "html_rows_cells": with_ctes(["menu_rows"], cells_explode("rws", "menu_rows")),
        "trim_header_footer": with_ctes(["menu_rows"], cells_explode(trim_hf("rws"), "menu_rows")),
        "menu_text": with_ctes(["menu_rows"], f"SELECT page_id, {menu_text(trim_hf('rws'))} AS menu FROM menu_rows"),
        "daily_menu": with_ctes(["menu_rows"], f"SELECT page_id, {menu_text(trim_hf('rws'))} AS menu FROM menu_rows"),
        # unknowns
        "log_unknown": with_ctes(["q"], """SELECT (row_number() OVER (ORDER BY arrival, question))::BIGINT AS id,
  question, NULL::VARCHAR AS answer FROM (SELECT text AS question, min(question_id) AS arrival FROM q
  WHERE text IS NOT NULL GROUP BY text)"""),
        "unknown_sites": answer_sql("q", "SELECT question_id, reason FROM ans WHERE is_unknown"),
        "fallback_answer": answer_sql("q", "SELECT question_id, answer FROM ans WHERE is_unknown"),
        "merge_answered": with_ctes(["kb", "export"], flatten_sql("m"), [(
            "m", """SELECT intent_pos, tag, patterns, responses, context_set FROM kb UNION ALL
  SELECT (intent_pos + (SELECT max(intent_pos) FROM kb) + 1)::INTEGER, tag, patterns, responses, context_set
  FROM export""")]),
        # chat
        "role_flag": with_ctes(["chat"], "SELECT conv_id, turn, role = 'user' AS is_user, role = 'bot' AS speakable FROM chat"),
    }
    # request / message flows share the answer CTEs
    reqp = [_req_parsed()]
    req_src = ("reqq", "SELECT event_id AS question_id, question AS text, ts AS as_of FROM reqp WHERE error IS NULL")
    out["append_turns"] = with_ctes(ANSWER_BASE + ["req"], """SELECT chat_id, (k * 2 + i)::BIGINT AS turn, role, text FROM (
  SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY ts, event_id) - 1 AS k, question, answer
  FROM reqp JOIN ans ON ans.question_id = reqp.event_id WHERE error IS NULL),
  (VALUES (0, 'user'), (1, 'bot')) v(i, role0) CROSS JOIN LATERAL (SELECT role0 AS role,
  CASE WHEN i = 0 THEN question ELSE answer END AS text)""", reqp + [req_src] + answer_ctes("reqq"))
    out["error_reply"] = with_ctes(ANSWER_BASE + ["req"], f"""SELECT event_id, chat_id,
  CASE WHEN error IS NOT NULL THEN {lit(K.BOT_ERROR_MESSAGE)} ELSE answer END AS reply
  FROM reqp LEFT JOIN ans ON ans.question_id = reqp.event_id""", reqp + [req_src] + answer_ctes("reqq"))
    msg_src = ("msgq", "SELECT event_id AS question_id, coalesce(text, '') AS text, ts AS as_of FROM msg")
    out["message_fanout"] = with_ctes(ANSWER_BASE + ["msg"], """SELECT event_id, chat_id, 'echo' AS kind,
  regexp_extract(text, '/echo (.+)', 1) AS reply FROM msg WHERE regexp_matches(text, '/echo (.+)')
  UNION ALL SELECT event_id, chat_id, 'answer', answer FROM msg JOIN ans ON ans.question_id = msg.event_id""",
                                      [msg_src] + answer_ctes("msgq"))
    out["missing_text"] = with_ctes(ANSWER_BASE + ["msg"], """SELECT event_id, '' AS question, answer, is_unknown
  FROM msg JOIN ans ON ans.question_id = msg.event_id WHERE msg.text IS NULL""", [msg_src] + answer_ctes("msgq"))
    out["stream_transcripts"] = out["final_only_latest"]
    body_src = ("bodies", """SELECT event_id, user_id AS chat_id, ts, CASE event_id % 10 WHEN 7 THEN '' WHEN 0 THEN
  concat('/echo ', event_type) WHEN 5 THEN concat('/echo ', event_type) ELSE event_type END AS question FROM events""")
    out["stream_fanout"] = with_ctes(ANSWER_BASE, f"""SELECT event_id, chat_id, 'answer' AS kind, answer AS reply, is_unknown
  FROM bodies JOIN ans ON ans.question_id = bodies.event_id
  UNION ALL SELECT event_id, chat_id, 'echo', substr(question, 7), false FROM bodies WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, chat_id, 'error', {lit(K.BOT_ERROR_MESSAGE)}, false FROM bodies WHERE event_id % 10 >= 8""",
                                     [body_src, ("bodyq", "SELECT event_id AS question_id, question AS text, ts AS as_of FROM "
                                                          "bodies WHERE event_id % 10 < 8")] + answer_ctes("bodyq"))
    out["stream_answers"] = with_ctes(ANSWER_BASE + ["msg"], """SELECT event_id, chat_id, answer
  FROM msg JOIN ans ON ans.question_id = msg.event_id""", [msg_src] + answer_ctes("msgq"))
    out["stream_unknown"] = with_ctes(ANSWER_BASE + ["msg"], """SELECT (row_number() OVER (ORDER BY arrival, question))::BIGINT
  AS id, question, NULL::VARCHAR AS answer FROM (SELECT coalesce(text, '') AS question, min(event_id) AS arrival
  FROM msg JOIN ans ON ans.question_id = msg.event_id WHERE is_unknown GROUP BY coalesce(text, ''))""",
                                      [msg_src] + answer_ctes("msgq"))
    out["stream_turns"] = with_ctes(ANSWER_BASE + ["msg"], """SELECT chat_id, (row_number() OVER (PARTITION BY chat_id
  ORDER BY ts, event_id, i) - 1)::BIGINT AS turn, role, text FROM (
  SELECT chat_id, ts, event_id, 0 AS i, 'user' AS role, coalesce(text, '') AS text FROM msg
  UNION ALL SELECT chat_id, ts, event_id, 1, 'bot', answer FROM msg JOIN ans ON ans.question_id = msg.event_id)""",
                                    [msg_src] + answer_ctes("msgq"))
    return out


def bag_common(a: str, b: str) -> str:
    """Multiset intersection size of the characters of two strings."""
    return (f"list_sum(list_transform(list_distinct(string_split({a}, '')), lambda ch: least("
            f"len(list_filter(string_split({a}, ''), lambda x: x = ch)), "
            f"len(list_filter(string_split({b}, ''), lambda x: x = ch)))))")


def _encode_ctes() -> list[tuple[str, str]]:
    return [
        ("tk", "SELECT conv_id, turn, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM tokens"),
        ("vocab", "SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM "
                  "(SELECT token, count(*) AS n FROM tk GROUP BY token)"),
        ("ids", f"SELECT conv_id, turn, list(id ORDER BY pos)[1:{K.MAX_LEN_TRAIN}] AS ids FROM tk "
                "JOIN vocab USING (token) GROUP BY conv_id, turn"),
        ("base", "SELECT c.conv_id, c.turn, c.role, coalesce(ids.ids, []::BIGINT[]) AS ids FROM chat c "
                 "LEFT JOIN ids USING (conv_id, turn)"),
        ("mx", "SELECT max(len(ids)) AS L FROM base"),
    ]


def _block_ctes(pairs: str) -> list[tuple[str, str]]:
    """M2 of the pairs (a, b) of a relation ``pairs`` (keys under 200 characters): ``exact`` (a, b, score).

    Longest common blocks by a table of lengths, segments by recursion."""
    grid = ("list_reduce(range(al, ah), lambda acc, i: list_append(acc, list_transform(range(bl, bh), lambda j: CASE WHEN "
            "substr(a, i::INTEGER + 1, 1) = substr(b, j::INTEGER + 1, 1) THEN 1 + coalesce(acc[len(acc)][j - bl], 0) ELSE 0 END::INTEGER)), "
            "[list_transform(range(bl, bh), lambda j: 0::INTEGER)])")
    cells = ("list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: "
             "{'k': grid[i - al + 2][j - bl + 1], 'i': -i, 'j': -j}))")
    best = (f"SELECT a, b, al, ah, bl, bh, m.k AS k, -m.i - m.k + 1 AS i, -m.j - m.k + 1 AS j FROM (SELECT *, list_sort(flatten({cells}), 'DESC')[1] AS m "
            f"FROM (SELECT *, {grid} AS grid FROM seg))")
    return [
        ("seg(a, b, al, ah, bl, bh)", f"""SELECT DISTINCT a, b, 0::BIGINT, length(a)::BIGINT, 0::BIGINT, length(b)::BIGINT FROM {pairs} WHERE a <> '' AND b <> ''
  UNION ALL SELECT a, b, c.al, c.ah, c.bl, c.bh FROM (SELECT a, b, unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j}},
    {{'al': i + k, 'ah': ah, 'bl': j + k, 'bh': bh}}]) AS c FROM ({best}) WHERE k > 0) WHERE c.al < c.ah AND c.bl < c.bh"""),
        ("blocks", f"SELECT a, b, sum(k) AS n FROM ({best}) GROUP BY a, b"),
        ("exact", f"""SELECT p.a, p.b, CASE WHEN p.a = p.b THEN 100 WHEN p.a = '' OR p.b = '' THEN 0
  ELSE {ratio('n', 'length(p.a) + length(p.b)')} END AS score FROM (SELECT DISTINCT a, b FROM {pairs}) p LEFT JOIN blocks USING (a, b)""")]


def _exact_sql() -> dict[str, str]:
    def recursive(sql):
        return sql.replace("WITH ", "WITH RECURSIVE ", 1)

    own = ("own", f"SELECT q.question_id, {key('lower(p.p_name)')} AS a, {key('lower(q.text)')} AS b FROM q JOIN part p ON p.p_partkey = q.question_id")
    out = {"token_sort_ratio_exact": recursive(with_ctes(
        ["q"], "SELECT question_id, score FROM own JOIN exact USING (a, b)", [own, *_block_ctes("own")]))}
    every = ("every", f"SELECT pkey AS a, qkey AS b FROM pk, (SELECT DISTINCT {key('lower(text)')} AS qkey FROM q)")
    out["fuzzy_gate_exact"] = recursive(with_ctes(["q", "pk"], f"""SELECT question_id, t AS threshold,
  EXISTS (SELECT 1 FROM exact WHERE b = {key('lower(q.text)')} AND score >= t) AS passed
  FROM q, (VALUES ({K.THRESHOLD_WEB}), ({K.THRESHOLD_LOCAL})) th(t)""", [every, *_block_ctes("every")]))
    flow = [(n, f"SELECT qkey FROM qk WHERE EXISTS (SELECT 1 FROM exact WHERE b = qkey AND score >= {K.THRESHOLD_WEB})" if n == "passed" else sql)
            for n, sql in answer_ctes("q")]
    out["answer_questions_exact"] = recursive(with_ctes(ANSWER_BASE + ["q"], "SELECT * FROM ans", [every, *_block_ctes("every"), *flow]))
    return out


def _stem_ctes() -> list[tuple[str, str]]:
    """T4 over the distinct tokens, a step of the published algorithm per relation: ``stems`` (t, w)."""
    from askbase.functions.stemming import STEP2, STEP3, STEP4
    form = ("CASE WHEN w = '' THEN '' ELSE list_reduce(string_split(w, ''), lambda a, ch: a || CASE WHEN ch IN ('a', 'e', 'i', 'o', 'u') "
            "OR (ch = 'y' AND ends_with(a, 'c')) THEN 'v' ELSE 'c' END, '') END")
    m = "(length({0}) - length(replace({0}, 'vc', '')))".format       # twice the measure
    w, f = "w[:length(w) - {}]".format, "f[:length(w) - {}]".format
    doubled = "(length(w) >= 2 AND w[-1] = w[-2] AND ends_with(f, 'c'))"
    cvc = lambda w, f: f"(ends_with({f}, 'cvc') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"

    def rules(table, least, extra=""):
        return "CASE WHEN length(t) <= 2 THEN w " + " ".join(
            f"WHEN ends_with(w, '{s}') THEN CASE WHEN {m(f(len(s)))} > {least}{extra if s == 'ion' else ''} THEN {w(len(s))} || '{r}' "
            f"ELSE w END" for s, r in table) + " ELSE w END"

    steps = [
        f"CASE WHEN length(t) <= 2 OR ends_with(w, 'ss') AND NOT ends_with(w, 'sses') THEN w WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') "
        f"THEN {w(2)} WHEN ends_with(w, 's') THEN {w(1)} ELSE w END",
        f"CASE WHEN length(t) <= 2 THEN w WHEN ends_with(w, 'eed') THEN CASE WHEN {m(f(3))} > 0 THEN {w(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') AND contains({f(2)}, 'v') THEN {w(2)} || '#' WHEN ends_with(w, 'ing') AND contains({f(3)}, 'v') "
        f"THEN {w(3)} || '#' ELSE w END",
    ]
    mend = (f"CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' "
            f"WHEN {doubled} AND w[-1] NOT IN ('l', 's', 'z') THEN {w(1)} WHEN {m('f')} = 2 AND {cvc('w', 'f')} THEN w || 'e' ELSE w END")
    later = [
        f"CASE WHEN length(t) > 2 AND ends_with(w, 'y') AND contains({f(1)}, 'v') THEN {w(1)} || 'i' ELSE w END",
        rules(STEP2, 0), rules(STEP3, 0), rules([(x, "") for x in STEP4], 2, f" AND right({w(3)}, 1) IN ('s', 't')"),
        f"CASE WHEN length(t) > 2 AND ends_with(w, 'e') AND ({m(f(1))} > 2 OR ({m(f(1))} = 2 AND NOT {cvc(w(1), f(1))})) THEN {w(1)} ELSE w END",
        f"CASE WHEN length(t) > 2 AND {m('f')} > 2 AND {doubled} AND ends_with(w, 'l') THEN {w(1)} ELSE w END",
    ]
    out, src = [("p0", "SELECT DISTINCT t, t AS w FROM (SELECT unnest(toks) AS t FROM tokens)")], "p0"

    def add(expr, extra=""):
        nonlocal src
        n = f"p{len(out)}"
        out.append((n, f"SELECT t, {expr} AS w{extra} FROM (SELECT *, {form} AS f FROM {src})"))
        src = n

    for e in steps:
        add(e)
    out.append(("marked", f"SELECT t, CASE WHEN length(t) > 2 THEN rtrim(w, '#') ELSE w END AS w, length(t) > 2 AND ends_with(w, '#') AS cut FROM {src}"))
    src = "marked"
    for e in [mend, *later]:
        add(e)
    return out + [("stems", f"SELECT t, w FROM {src}")]


def oracle_sql() -> dict[str, str]:
    out = _plain_sql() | _exact_sql()
    out["stem_tokens"] = with_ctes(["tokens"], """SELECT conv_id, turn, coalesce(s, '') AS stemmed FROM tokens LEFT JOIN (
  SELECT conv_id, turn, string_agg(w, ' ' ORDER BY pos) AS s FROM (SELECT conv_id, turn, unnest(toks) AS t, unnest(range(len(toks))) AS pos
  FROM tokens) JOIN stems USING (t) GROUP BY conv_id, turn) USING (conv_id, turn)""", _stem_ctes())
    out["encode_pad"] = with_ctes(["tokens"], """SELECT conv_id, turn,
  array_to_string(list_concat(ids, list_resize([]::BIGINT[], L - len(ids), 0)), ' ') AS ids,
  L::INTEGER AS padded_len, len(ids)::INTEGER AS n_tokens FROM base, mx""", _encode_ctes())
    out["zip_examples"] = with_ctes(["tokens"], """SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 0 WHEN 'bot' THEN 1 ELSE 2 END AS labels, len(ids)::INTEGER AS n_tokens FROM base""", _encode_ctes())
    held = ("held", f"""SELECT conv_id, turn, label FROM (SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 0 WHEN 'bot' THEN 1 ELSE 2 END AS label, row_number() OVER (ORDER BY
  {md5_bucket("'123'", "concat_ws(':', conv_id, turn)")}, concat_ws(':', conv_id, turn)) - 1 AS rn, count(*) OVER () AS n
  FROM chat) WHERE rn < ceil(0.25 * n)""")
    out["encode_pad_serve"] = with_ctes(["tokens"], f"""SELECT conv_id, turn,
  array_to_string(list_concat(ids, list_resize([]::BIGINT[], L - len(ids), 0)), ' ') AS ids, L::INTEGER AS padded_len
  FROM sbase, (SELECT max(len(ids)) AS L FROM sbase)""", [
        held, ("tk", "SELECT conv_id, turn, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM tokens"),
        ("vocab", "SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM (SELECT token, count(*) AS n "
                  "FROM tk ANTI JOIN held USING (conv_id, turn) GROUP BY token)"),
        ("sids", f"""SELECT conv_id, turn, list(coalesce(id, (SELECT max(id) + 1 FROM vocab)) ORDER BY pos)
  [1:{K.MAX_LEN_SERVE}] AS ids FROM tk SEMI JOIN held USING (conv_id, turn) LEFT JOIN vocab USING (token)
  GROUP BY conv_id, turn"""),
        ("sbase", "SELECT h.conv_id, h.turn, coalesce(sids.ids, []::BIGINT[]) AS ids FROM held h "
                  "LEFT JOIN sids USING (conv_id, turn)")])
    counted = [held, ("words", """SELECT token, label, count(*) AS n FROM (SELECT unnest(toks) AS token, CASE role WHEN 'user'
  THEN 0 WHEN 'bot' THEN 1 ELSE 2 END AS label FROM tokens JOIN chat USING (conv_id, turn) ANTI JOIN held USING (conv_id, turn))
  GROUP BY token, label"""),
               ("classes", """SELECT label, count(*) AS n_rows, (SELECT coalesce(sum(n), 0) FROM words w WHERE w.label = c.label) AS n_words
  FROM (SELECT CASE role WHEN 'user' THEN 0 WHEN 'bot' THEN 1 ELSE 2 END AS label FROM chat ANTI JOIN held USING (conv_id, turn)) c
  GROUP BY label"""),
               ("scores", """SELECT t.conv_id, t.turn, c.label AS pred, round(ln(c.n_rows / (SELECT sum(n_rows) FROM classes))
  + coalesce((SELECT sum(ln(w.n + 1.0::DOUBLE)) FROM (SELECT unnest(t.toks) AS token) x JOIN words w ON w.token = x.token AND w.label = c.label), 0)
  - len(t.toks) * ln(c.n_words + (SELECT count(DISTINCT token) FROM words) + 1.0::DOUBLE), 9) AS score
  FROM tokens t SEMI JOIN held USING (conv_id, turn) CROSS JOIN classes c"""),
               ("guess", """SELECT held.conv_id, held.turn, held.label, arg_min(pred, (-score, pred)) AS pred, max(score) AS score
  FROM held JOIN scores USING (conv_id, turn) GROUP BY ALL""")]
    out["train_count_model"] = with_ctes(["tokens"], "SELECT conv_id, turn, label, pred, round(score, 6) AS score FROM guess", counted)
    out["eval_count_model"] = with_ctes(["tokens"], out["macro_prf"][out["macro_prf"].index("SELECT round(sum(tp)"):].replace(
        "FROM pred", "FROM guess"), counted)
    # what any right classifier gives on the held-out rows
    out["train_classifier"] = with_ctes(["chat"], """SELECT conv_id, turn, label, true AS in_label_set, true AS accurate
  FROM held""", [held])
    out["save_load_model"] = with_ctes(["chat"], "SELECT conv_id, turn, true AS same, true AS named FROM held", [held])
    out["eval_summary"] = with_ctes(["chat"], """SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes,
  true AS same_accuracy, true AS same_f1, true AS same_precision, true AS same_recall FROM held""", [held])
    return out
