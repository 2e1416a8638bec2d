"""SQL that gives the same rows as the queries, for DuckDB."""

from __future__ import annotations

from labelloom import constants as C
from labelloom.functions.text import WHITESPACE
from labelloom.plans.queries import AWKWARD, EVENT_LABELS, LOGIT_PARTS, TARGET, VOCAB_SIZE, WORDS

# The same white space as a character class; \s has most of the ASCII part.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _case(value: str, mapping: dict, default: str = "NULL") -> str:
    def literal(x: object) -> str:
        return str(x) if isinstance(x, int) else f"'{x}'"

    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
    return f"CASE {value} {whens} ELSE {default} END"


def _strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


_CLASS = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END"
_LABELLED = f"""labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source AS category, l.quality, {_CLASS} AS class
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_FEEDBACK = f"""{_LABELLED}, feedback AS (
  SELECT doc_id, lang, category, class, unnest(string_split(text, chr(10))) AS sentence,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no
  FROM labelled)"""
_FEEDBACK_ONLY = _FEEDBACK.removeprefix(_LABELLED + ", ") + ", "
_GENERATED = f"""{_LABELLED}, responses AS (
  SELECT doc_id, category, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS label,
         {_strip("array_to_string([x || ',' || class for x in string_split(text, chr(10))], chr(10))")} AS response
  FROM labelled), answer_lines AS (
  SELECT doc_id, category, label, unnest(string_split(response, chr(10))) AS line,
         CAST(generate_subscripts(string_split(response, chr(10)), 1) - 1 AS INTEGER) AS line_no
  FROM responses), generated AS (
  SELECT doc_id, category, label, line_no,
         replace(regexp_extract(line, '(?s)^(.*),([^,]*)$', 1), '"', '') AS sentence,
         {_strip("regexp_extract(line, '(?s)^(.*),([^,]*)$', 2)")} AS written
  FROM answer_lines WHERE contains(line, ',')), accepted_lines AS (
  SELECT doc_id, category, label, line_no, sentence, label AS sentiment FROM generated
  WHERE written = CAST(label AS VARCHAR) AND length(sentence) BETWEEN {C.MIN_CHARS} AND {C.MAX_CHARS})"""


def _by_share(pos: str, n: str) -> str:
    train = f"floor(CAST({n} AS DOUBLE) * {C.TRAIN_FRACTION}::DOUBLE)"
    val = f"floor(CAST({n} AS DOUBLE) * {C.VAL_FRACTION}::DOUBLE)"
    return f"CASE WHEN {pos} < {train} THEN 'train' WHEN {pos} < {train} + {val} THEN 'val' ELSE 'test' END"


def _ordered(table: str, key: str, columns: str) -> str:
    """Rows of a table with their ordered split."""
    return f"""(SELECT {columns}, {_by_share("pos", "n")} AS split FROM (
      SELECT {columns}, row_number() OVER (ORDER BY {key}) - 1 AS pos, count(*) OVER () AS n FROM {table}))"""


_SPLIT_FEEDBACK = f"""{_FEEDBACK}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id || '-' || line_no || '-0'), doc_id, line_no) - 1 AS pos,
         count(*) OVER (PARTITION BY class) AS n FROM feedback), split_feedback AS (
  SELECT *, {_by_share("pos", "n")} AS split FROM numbered)"""

def _events(target: int) -> str:
    return f"""stored_or_new AS (
  SELECT event_id, ts, event_type AS category, {_case("event_type", EVENT_LABELS)} AS label,
         event_type = 'error' AS is_error, ts < TIMESTAMP '2024-01-01 12:00:00' AS is_early FROM events),
  categories AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in EVENT_LABELS.items())}) t(category, label)),
  progress AS (SELECT category, label, count(*) AS n FROM stored_or_new WHERE is_error OR is_early GROUP BY ALL),
  remaining AS (
    SELECT c.category, c.label, greatest({target} - coalesce(n, 0), 0) AS remaining
    FROM categories c LEFT JOIN progress p ON c.category = p.category AND c.label = p.label
    WHERE coalesce(n, 0) < {target})"""


def _id(split: str, pos: str) -> str:
    digest = f"md5({split} || '-' || {pos})"
    letters = [f"chr(65 + CAST('0x' || substr({digest}, {start}, 4) AS INTEGER) % 26)" for start in (1, 5, 9)]
    return f"CAST({C.FIRST_ID} + {pos} AS VARCHAR) || " + " || ".join(letters)


_TOKENS = f"[t for t in string_split(lower({_collapse('text')}), ' ') if t <> '']"
_VOCAB = f"""counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token),
  vocab AS (
    SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + {C.FIRST_TOKEN_ID - 1} AS INTEGER) AS id
    FROM counts QUALIFY row_number() OVER (ORDER BY n DESC, token) <= {VOCAB_SIZE})"""


def _encoded(source: str, columns: str, max_len: int) -> str:
    room = max_len - 2
    return f"""words AS (
      SELECT doc_id, unnest({_TOKENS}[1:{room}]) AS token, generate_subscripts({_TOKENS}[1:{room}], 1) AS place FROM {source}),
      ids AS (
        SELECT w.doc_id, list(coalesce(v.id, {C.UNKNOWN_ID}) ORDER BY place) AS ids
        FROM words w LEFT JOIN vocab v ON w.token = v.token GROUP BY w.doc_id),
      full_ids AS (
        SELECT {columns}, coalesce(ids, []::INTEGER[]) AS ids FROM {source} s LEFT JOIN ids i ON s.doc_id = i.doc_id),
      encoded AS (
        SELECT * EXCLUDE (ids),
          array_to_string(list_concat([{C.START_ID}], ids, [{C.END_ID}], [{C.PAD_ID} for x in range({room} - len(ids))]), ' ') AS input_ids,
          array_to_string(list_concat([1 for x in range(len(ids) + 2)], [0 for x in range({room} - len(ids))]), ' ') AS attention_mask
        FROM full_ids)"""


_PARTS = ", ".join(f"list_sum([x::DOUBLE for x in embedding[{start}:{start + n - 1}]])" for start, n in LOGIT_PARTS)
_PREDICTED = f"""logits AS (
  SELECT vec_id, label % 3 AS label, [{_PARTS}] AS logits FROM embeddings),
  powers AS (SELECT *, [exp(x - list_max(logits)) for x in logits] AS powers FROM logits),
  probable AS (SELECT *, [x / list_sum(powers) for x in powers] AS p FROM powers),
  predicted AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS prediction, -ln(p[label + 1]) AS loss FROM probable)"""
_RIGHT = "avg(CAST(prediction = label AS INTEGER)::DOUBLE)"


def _success(name: str) -> str:
    return f"""'{{"status":"success","data":{{"classify":"' || {name} || '"}}}}'"""


_ERROR = f"""'{{"status":"error","message":"{C.MISSING_TEXT_MESSAGE}"}}'"""
_FITTING = "length(line) - length(replace(line, ',', ''))"

_STREAM_SCORES = f"""WITH t AS (SELECT conv_id, turn, {_collapse("text")} AS text FROM conversations),
        c AS (SELECT *, [length(text) - length(replace(text, x, '')) for x in ['a', 'e', 'i']] AS c FROM t)
        SELECT conv_id, turn, CASE WHEN text = '' THEN {_ERROR}
        ELSE {_success(_case("list_position(c, list_max(c)) - 1", C.SERVING_NAMES))} END AS response FROM c"""

ORACLES: dict[str, str] = {
    "clean_text": f"""SELECT doc_id, {_strip("text")} AS stripped, {_collapse("text")} AS collapsed,
        replace(text, '"', '') AS unquoted FROM (SELECT doc_id, {AWKWARD} AS text FROM documents)""",
    "nonblank_lines": f"""WITH {_FEEDBACK} SELECT doc_id, line_no, {_strip("sentence")} AS sentence
        FROM (SELECT doc_id, line_no, {AWKWARD} AS sentence FROM (SELECT doc_id, line_no, sentence AS text FROM feedback))
        WHERE {_strip("sentence")} <> ''""",
    "label_map": f"""SELECT doc_id, word, CAST(code AS VARCHAR) AS code, name, {_case("name", {v: k for k, v in C.PROMPT_NAMES.items()})} AS code_of_name
        FROM (SELECT *, {_case("code", C.PROMPT_NAMES, f"'{C.PROMPT_DEFAULT}'")} AS name
        FROM (SELECT *, {_case("word", C.LABEL_WORDS)} AS code
        FROM (SELECT doc_id, {_case(_CLASS, WORDS)} AS word FROM labels)))""",
    "parse_label": r"""SELECT event_id,
        CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '\s*[+-]?\d+\s*')
             THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 1 END AS parsed,
        CASE WHEN regexp_full_match(props, '\s*[+-]?\d+\s*') THEN CAST(props AS INTEGER) ELSE 1 END AS failed
        FROM events""",
    "generated_lines": f"WITH {_GENERATED} SELECT doc_id, line_no, sentence, sentiment FROM accepted_lines",
    "paraphrase_requests": f"""WITH {_SPLIT_FEEDBACK}
        SELECT doc_id, line_no, replace(replace('{C.PARAPHRASE_REQUEST.replace("%s", "<1>", 1).replace("%s", "<2>")}',
          '<1>', {_case("class", C.PROMPT_NAMES, f"'{C.PROMPT_DEFAULT}'")}), '<2>', sentence) AS prompt
        FROM split_feedback WHERE split <> 'train'""",
    "paraphrase_merge": f"""WITH {_FEEDBACK} SELECT doc_id, line_no, lang, class,
        CASE WHEN lang = 'en' THEN replace({_strip("""' "Again: ' || sentence || '" '""")}, '"', '') ELSE sentence END AS sentence
        FROM feedback""",
    "paraphrase_splits": f"""WITH {_SPLIT_FEEDBACK} SELECT doc_id, line_no, lang, class, split,
        CASE WHEN lang = 'en' AND split <> 'train' THEN replace({_strip("'Again: ' || sentence")}, '"', '') ELSE sentence END AS sentence
        FROM split_feedback""",
    "quota_progress": f"WITH {_events(TARGET)} SELECT category, label, n FROM progress",
    "quota_remaining": f"""WITH {_events(TARGET)} SELECT category, label, CAST(remaining AS BIGINT) AS remaining,
        category || '_' || label AS category_key FROM remaining""",
    "quota_total": f"""WITH {_events(TARGET)} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total
        FROM categories c JOIN progress p ON c.category = p.category AND c.label = p.label""",
    "quota_accept": f"""WITH {_events(TARGET)} SELECT e.event_id, e.category, e.label
        FROM stored_or_new e JOIN remaining r ON e.category = r.category AND e.label = r.label
        WHERE e.is_error OR NOT e.is_early
        QUALIFY row_number() OVER (PARTITION BY e.category, e.label ORDER BY e.ts, e.event_id) <= remaining""",
    "quota_accept_large": f"""WITH {_events(20_050)} SELECT e.event_id, e.category, e.label
        FROM stored_or_new e JOIN remaining r ON e.category = r.category AND e.label = r.label
        WHERE e.is_error OR NOT e.is_early
        QUALIFY row_number() OVER (PARTITION BY e.category, e.label ORDER BY e.ts, e.event_id) <= remaining""",
    "filled_categories": f"""WITH {_GENERATED} SELECT category, label, doc_id, line_no, sentence, sentiment FROM accepted_lines
        QUALIFY row_number() OVER (PARTITION BY category, label ORDER BY doc_id, line_no) <= 20""",
    "split_ordered": f"SELECT doc_id, split FROM {_ordered('documents', 'doc_id', 'doc_id')}",
    "tail_holdout": f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
        SELECT doc_id, 'train' AS split FROM r UNION ALL
        SELECT doc_id, 'test' FROM r WHERE pos >= n - floor(n::DOUBLE * {C.HOLDOUT_FRACTION}::DOUBLE)""",
    "tail_holdout_disjoint": f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN pos >= n - floor(n::DOUBLE * {C.HOLDOUT_FRACTION}::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""",
    "split_stratified": f"WITH {_SPLIT_FEEDBACK} SELECT doc_id, line_no, class, split FROM split_feedback",
    "split_profile": f"""SELECT split, count(*) AS n_rows, 5 AS n_columns
        FROM {_ordered('documents', 'doc_id', 'doc_id')} GROUP BY split""",
    "preview": "SELECT * FROM documents ORDER BY doc_id LIMIT 5",
    "batches": f"""SELECT doc_id, pos, pos // {C.BATCH_SIZE} AS batch FROM (
        SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '-0-0'), doc_id) - 1 AS pos FROM documents)""",
    "ordered_batches": f"""SELECT doc_id, pos, pos // {C.BATCH_SIZE} AS batch FROM (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)""",
    "epoch_order": f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
        m AS (SELECT r, ('0x' || substr(md5('0-2-' || r), 1, 15))::BIGINT % (SELECT max(n) FROM p) AS middle
              FROM range((SELECT 6 * length(bin(max(n))) FROM p)) t(r)),
        k AS (SELECT list({{'key': '0-2-' || r, 'middle': middle, 'x': 0::BIGINT}} ORDER BY r) AS rounds FROM m),
        e AS (SELECT doc_id, pos, list_reduce(list_prepend({{'key': '', 'middle': 0::BIGINT, 'x': pos}}, rounds), lambda a, b: {{'key': '', 'middle': 0::BIGINT,
              'x': CASE WHEN substr(md5(b.key || '-' || greatest(a.x, (b.middle - a.x + n) % n)), 1, 1) >= '8' THEN (b.middle - a.x + n) % n ELSE a.x END}}).x AS place
              FROM p, k)
        SELECT doc_id, pos, place, place // {C.BATCH_SIZE} AS batch FROM e""",
    "final_ids": f"""SELECT doc_id, split, {_id("split", "pos")} AS id FROM (
        SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos
        FROM {_ordered('documents', 'doc_id', 'doc_id')})""",
    "ensure_columns": """SELECT doc_id, coalesce(CAST(nullif(quality, 0) AS VARCHAR), 'nan') AS text, toxic, 1 AS class FROM labels""",
    "combine_sources": """SELECT doc_id AS key, text, 'documents' AS source FROM documents
        UNION ALL SELECT conv_id, text, 'conversations' FROM conversations
        UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark""",
    "vocab": f"WITH {_VOCAB} SELECT token, n, id FROM vocab",
    "encode_fixed": f"""WITH {_VOCAB}, {_encoded("documents", "s.doc_id", C.MAX_LEN)}
        SELECT doc_id, input_ids, attention_mask FROM encoded""",
    "training_columns": f"""WITH {_LABELLED}, {_VOCAB}, {_encoded("labelled", "s.class AS labels", C.SERVING_MAX_LEN)}
        SELECT input_ids, attention_mask, labels FROM encoded""",
    "softmax_argmax": f"""WITH {_PREDICTED} SELECT vec_id, round(p[1], 9) AS p0, round(p[2], 9) AS p1, round(p[3], 9) AS p2,
        prediction FROM predicted""",
    "score_records": f"""WITH {_PREDICTED} SELECT CAST(vec_id AS VARCHAR) AS text, {_case("prediction", C.OFFLINE_NAMES)} AS sentiment,
        round(list_max(p), 9) AS confidence, printf('%.4f', p[1]) AS p0, printf('%.4f', p[2]) AS p1, printf('%.4f', p[3]) AS p2
        FROM predicted""",
    "accuracy_f1_loss": f"""WITH {_PREDICTED} SELECT label, round({_RIGHT}, 6) AS accuracy, round({_RIGHT}, 6) AS f1,
        round(avg(loss), 6) AS loss, round(avg(loss), 6) AS logit_loss FROM predicted GROUP BY label""",
    "pooled_metrics": f"""WITH {_PREDICTED} SELECT count(*) AS n_rows, round({_RIGHT}, 6) AS accuracy, round({_RIGHT}, 6) AS f1,
        round(avg(loss), 6) AS loss FROM predicted""",
    "metrics_by_split": f"""WITH {_PREDICTED}
        SELECT {_case("split", C.DATASET_NAMES)} AS dataset, round({_RIGHT}, 6) AS accuracy, round({_RIGHT}, 6) AS f1
        FROM {_ordered('predicted', 'vec_id', 'vec_id, label, prediction')} GROUP BY split
        UNION ALL SELECT '{C.BASELINE_NAME}', {C.BASELINE_ACCURACY}::DOUBLE, {C.BASELINE_F1}::DOUBLE""",
    "select_best": """WITH c AS (
          SELECT CAST(k AS INTEGER) AS candidate, label % 3 AS label, [x::DOUBLE for x in embedding[4 * k + 1 : 4 * k + 4]] AS four,
            [four[1], four[2], four[3] + four[4]] AS logits FROM embeddings, range(16) t(k)),
        e AS (SELECT *, [exp(x - list_max(logits)) for x in logits] AS e FROM c),
        p AS (SELECT *, [x / list_sum(e) for x in e] AS p FROM e),
        f AS (SELECT candidate, avg(CAST(list_position(p, list_max(p)) - 1 = label AS INTEGER)::DOUBLE) AS val_f1 FROM p GROUP BY candidate)
        SELECT candidate, round(val_f1, 6) AS val_f1 FROM f ORDER BY f.val_f1 DESC, candidate LIMIT 1""",
    "respond_json": f"""SELECT conv_id, turn, CASE WHEN role = 'system' OR {_strip("text")} = '' THEN {_ERROR}
        ELSE {_success(_case("length(" + _strip("text") + ") % 3", C.SERVING_NAMES))} END AS response FROM conversations""",
    "fit_checks": f"""WITH {_SPLIT_FEEDBACK} SELECT split, count(*) AS n_rows, true AS in_range, true AS sums_to_one,
        true AS beats_majority FROM split_feedback GROUP BY split""",
    "pass_checks": f"""SELECT CAST(k AS INTEGER) AS passes, true AS objective_fell, true AS in_range, true AS best_kept
        FROM range(1, {C.MAX_PASSES + 1}) t(k) WHERE EXISTS (SELECT 1 FROM documents)""",
    "zip_by_position": f"""WITH {_FEEDBACK} SELECT 'train' AS split, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos,
        {_strip("sentence")} AS sentence, CAST(class AS VARCHAR) AS sentiment FROM feedback WHERE {_strip("sentence")} <> ''""",
    "zip_tables": """SELECT a.pos, a.doc_id, b.n_chars, b.by_length FROM
        (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) a JOIN
        (SELECT n_chars, doc_id AS by_length, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents) b ON a.pos = b.pos""",
    "csv_round_trip": f"SELECT {AWKWARD} AS sentence, lang AS sentiment FROM documents",
    "parquet_round_trip": f"""SELECT split, text AS sentence, lang AS sentiment
        FROM {_ordered('documents', 'doc_id', 'text, lang')}""",
    "final_csv_round_trip": f"""WITH {_LABELLED} SELECT split, {_id("split", "pos")} AS id, text, class FROM (
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos
        FROM {_ordered('labelled', 'doc_id', 'doc_id, text, class')})""",
    "raw_rows": f"""WITH {_LABELLED} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, coalesce({AWKWARD}, '') AS text,
        CASE WHEN class = 0 THEN 1 ELSE class END AS class FROM labelled""",
    "lenient_rows": f"""WITH {_FEEDBACK}, plain AS (SELECT replace(sentence, '"', '') AS line FROM feedback)
        SELECT nullif(string_split(line, ',')[1], '') AS sentence, nullif(string_split(line, ',')[2], '') AS sentiment
        FROM plain WHERE line <> '' AND {_FITTING} <= 1""",
    "lenient_split": f"""WITH awkward AS (SELECT doc_id, {AWKWARD} AS sentence, lang AS sentiment FROM documents)
        SELECT sentence, sentiment, split FROM {_ordered('awkward', 'doc_id', 'sentence, sentiment')}""",
    "lenient_holdout": f"""WITH {_FEEDBACK}, plain AS (SELECT doc_id, line_no, replace(sentence, '"', '') AS line FROM feedback),
        r AS (SELECT nullif(string_split(line, ',')[1], '') AS sentence, nullif(string_split(line, ',')[2], '') AS sentiment,
          row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos, count(*) OVER () AS n FROM plain WHERE line <> '' AND {_FITTING} <= 1)
        SELECT sentence, sentiment, 'train' AS split FROM r UNION ALL
        SELECT sentence, sentiment, 'test' FROM r WHERE pos >= n - floor(n::DOUBLE * {C.HOLDOUT_FRACTION}::DOUBLE)""",
    "final_corpus": f"""WITH {_GENERATED.replace("responses AS (", _FEEDBACK_ONLY + "responses AS (", 1)},
        aligned AS (SELECT 'aligned' AS source, split, replace(sentence, '"', '') AS sentence, class AS sentiment FROM {_ordered(
            f"(SELECT doc_id, line_no, {_strip('sentence')} AS sentence, class FROM feedback WHERE {_strip('sentence')} <> '')",
            'doc_id, line_no', 'sentence, class')}),
        numbered AS (SELECT replace(nullif(text, ''), '"', '') AS sentence, {_case("class", {0: 0, 2: 2})} AS sentiment,
            row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM labelled),
        worded AS (SELECT 'worded' AS source, CASE WHEN pos >= n - floor(n::DOUBLE * {C.HOLDOUT_FRACTION}::DOUBLE) THEN 'test' ELSE 'train' END AS split,
            sentence, sentiment FROM numbered),
        capped AS (SELECT * FROM accepted_lines QUALIFY row_number() OVER (PARTITION BY category, label ORDER BY doc_id, line_no) <= 20),
        filled AS (SELECT 'filled' AS source, split, sentence, sentiment FROM {_ordered('capped', 'category, label, doc_id, line_no', 'sentence, sentiment')}),
        combined AS (FROM aligned UNION ALL FROM worded UNION ALL FROM filled),
        raw AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY source, sentence NULLS FIRST, sentiment NULLS FIRST) - 1 AS pos FROM combined)
        SELECT split, {_id("split", "pos")} AS id, sentence AS text, coalesce(sentiment, 1) AS class FROM raw""",
    "unquoted_round_trip": "SELECT text AS sentence, lang AS sentiment FROM documents",
    "escaped_rows": f"SELECT {AWKWARD} AS sentence, lang AS sentiment FROM documents",
    "append_and_rewrite": f"""SELECT event_id, event_type AS category, {_case("event_type", EVENT_LABELS)} AS label,
        event_type || '_' || {_case("event_type", EVENT_LABELS)} AS category_key FROM events""",
    "stream_quota": f"""SELECT event_id, event_type AS category, {_case("event_type", EVENT_LABELS)} AS label FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= {TARGET}""",
    "stream_generated": f"""WITH {_GENERATED} SELECT category, label, doc_id, line_no, sentence, sentiment FROM accepted_lines
        QUALIFY row_number() OVER (PARTITION BY category, label ORDER BY doc_id, line_no) <= 20""",
    "stream_scores": _STREAM_SCORES,
    "answered_requests": _STREAM_SCORES,
    "corpus_slice": f"""WITH {_FEEDBACK}, accepted AS (
          SELECT doc_id, line_no, class FROM feedback WHERE length(replace(sentence, '"', '')) BETWEEN {C.MIN_CHARS} AND {C.MAX_CHARS}
          QUALIFY row_number() OVER (PARTITION BY category, class ORDER BY doc_id, line_no) <= 50),
        numbered AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id || '-' || line_no || '-0'), doc_id, line_no) - 1 AS pos,
          count(*) OVER (PARTITION BY class) AS n FROM accepted)
        SELECT {_by_share("pos", "n")} AS split, class, count(*) AS n_rows FROM numbered GROUP BY ALL""",
}
