"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans: pairs come from a
brute-force self-join, the exact split from a global ORDER BY ... LIMIT,
outcome counts from enumerated combinations.  Constants (token ids, the
template, the system message) come from the same Python values the Spark
side uses.
"""

from __future__ import annotations

from ..functions.tokens import CP_EOD, CP_IM_END, CP_IM_START, IGNORE_INDEX, CodepointTokenizer
from ..operators import annotate, chatml, encode, split
from . import catalog

TOK = CodepointTokenizer()
CFG = encode.EncodeConfig()

# Python str.isspace() characters as an RE2 class.
_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# what float() strips: the same without U+001C-U+001F
_FLOAT_SPACE = _SPACE.replace(r"\x1c-\x20", r"\x20")
_GRAMMAR = r"(?i)[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)"
_JAVA_ONLY = r"(?i)[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?[fd]|0x[0-9a-f]*(\.[0-9a-f]*)?p[+-]?\d+[fd]?)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def norm_sql(x: str) -> str:
    t = f"regexp_replace({x}, '^{_FLOAT_SPACE}+|{_FLOAT_SPACE}+$', '', 'g')"
    u = f"regexp_replace({t}, '([0-9])_([0-9])', '\\1\\2', 'g')"
    u = f"regexp_replace({u}, '([0-9])_([0-9])', '\\1\\2', 'g')"
    return f"regexp_replace({u}, '(?i)^[+-](nan)$', '\\1')"


def parse_sql(x: str) -> str:
    n = norm_sql(x)
    return f"(CASE WHEN regexp_full_match({n}, '{_GRAMMAR}') THEN TRY_CAST({n} AS DOUBLE) END)"


def class_sql(x: str) -> str:
    n = norm_sql(x)
    v = f"TRY_CAST({n} AS DOUBLE)"
    ok = f"regexp_full_match({n}, '{_GRAMMAR}')"
    return (
        f"(CASE WHEN {x} IS NULL THEN 'null' WHEN {ok} AND isnan({v}) THEN 'nan' "
        f"WHEN {ok} AND isinf({v}) THEN 'inf' WHEN {ok} THEN 'number' "
        f"WHEN regexp_full_match({n}, '{_JAVA_ONLY}') THEN 'spark_only' ELSE 'rejected' END)"
    )


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def img_prompt_sql(prompt: str, img: str) -> str:
    return f"('Picture 1: <img>' || coalesce({img}, 'None') || '</img>' || chr(10) || {strip_sql(prompt)})"


# ---------------------------------------------------------------- fixtures

FLINE = f"""fline AS (
  SELECT l_orderkey AS prompt_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS comp_idx,
    'Describe what order ' || {s('l_orderkey')} || ' contains.' AS prompt,
    'img/' || {s('l_orderkey')} || '.jpg' AS img_path,
    'm' || {s('l_suppkey % 12')} AS model,
    'resp-' || {s('l_partkey')} || '-' || {s('l_suppkey')} || '-' || {s('l_linenumber')} AS response,
    {s('1 + CAST(l_quantity AS BIGINT) % 5')} AS r_help,
    CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE {s('1 + l_suppkey % 5')} END AS r_eth,
    CASE WHEN l_partkey % 17 = 0 THEN 'N/A' WHEN l_partkey % 19 = 0 THEN 'nan' WHEN l_partkey % 23 = 0 THEN '4d'
         WHEN l_partkey % 29 = 0 THEN ' 3 ' ELSE {s('1 + l_partkey % 5')} END AS r_vis,
    'line ' || {s('l_linenumber')} || ' part ' || {s('l_partkey')} AS rationale
  FROM lineitem)"""

FTEXT = f"""ftext AS (
  SELECT d.doc_id // 4 AS prompt_id, CAST(d.doc_id % 4 AS BIGINT) AS comp_idx, b.text AS prompt,
    'img/' || {s('d.doc_id // 4')} || '.jpg' AS img_path, d.source AS domain,
    'm' || {s('(d.doc_id * 7) % 12')} AS model, d.text AS response,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN '5' ELSE '2' END AS r_help,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN '1' ELSE '5' END AS r_eth,
    {s('1 + d.n_chars % 5')} AS r_vis,
    'from ' || d.source || chr(10) || 'Rating: see scale' AS rationale
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN benchmark b ON b.item_id = (d.doc_id // 4) % (SELECT count(*) FROM benchmark))"""


def scored(src: str) -> str:
    """Mean over present aspects, in map order (help, ethics, faithfulness)."""
    h, e, v = parse_sql("r_help"), parse_sql("r_eth"), parse_sql("r_vis")
    return f"""{src}_scored AS (
  SELECT *,
    CASE WHEN r_help IS NULL AND r_eth IS NULL THEN {v} / 1
         WHEN r_eth IS NULL THEN ({h} + {v}) / 2
         WHEN r_help IS NULL THEN ({e} + {v}) / 2
         ELSE ({h} + {e} + {v}) / 3 END AS score,
    CAST((r_help IS NOT NULL)::INT + (r_eth IS NOT NULL)::INT + 1 AS BIGINT) AS n_aspects
  FROM {src})"""


def pairs_cte(src: str, name: str = "pairs") -> str:
    return f"""{name} AS (
  SELECT a.prompt_id, a.comp_idx AS comp_i, b.comp_idx AS comp_j,
    {img_prompt_sql('a.prompt', 'a.img_path')} AS prompt,
    CASE WHEN a.score > b.score THEN a.response ELSE b.response END AS chosen,
    CASE WHEN a.score > b.score THEN b.response ELSE a.response END AS rejected
  FROM {src}_scored a JOIN {src}_scored b ON a.prompt_id = b.prompt_id AND a.comp_idx < b.comp_idx
  WHERE a.score IS NOT NULL AND b.score IS NOT NULL AND NOT isnan(a.score) AND NOT isnan(b.score)
    AND a.score <> b.score AND a.response IS NOT NULL AND b.response IS NOT NULL)"""


FLINE_PAIRS = f"WITH {FLINE},\n{scored('fline')},\n{pairs_cte('fline')}\n"
FTEXT_PAIRS = f"WITH {FTEXT},\n{scored('ftext')},\n{pairs_cte('ftext')}\n"

PAIR_SELECT = "SELECT prompt_id, comp_i, comp_j, prompt, chosen, rejected FROM pairs"


def pair_outcomes_sql() -> str:
    combos = f"""combos AS (
  SELECT CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'unparseable'
              WHEN isnan(a.score) OR isnan(b.score) THEN 'nan'
              WHEN a.score = b.score THEN 'tie'
              WHEN a.response IS NULL OR b.response IS NULL THEN 'missing_response'
              ELSE 'pair' END AS outcome
  FROM fline_scored a JOIN fline_scored b ON a.prompt_id = b.prompt_id AND a.comp_idx < b.comp_idx)"""
    parts = ["SELECT 'combinations' AS outcome, CAST(count(*) AS BIGINT) AS n_pairs FROM combos"]
    for o in ("unparseable", "nan", "tie", "missing_response", "pair"):
        parts.append(f"SELECT '{o}', CAST(count(*) FILTER (WHERE outcome = '{o}') AS BIGINT) FROM combos")
    return f"WITH {FLINE},\n{scored('fline')},\n{combos}\n" + "\nUNION ALL\n".join(parts)


def flat_annotations_sql(src: str) -> str:
    return f"""SELECT prompt_id, comp_idx, model, response,
  concat_ws('|', CASE WHEN r_help IS NOT NULL THEN 'Helpfulness' END,
                 CASE WHEN r_eth IS NOT NULL THEN 'Ethical Considerations' END, 'Visual Faithfulness') AS aspects,
  concat_ws('|', r_help, r_eth, r_vis) AS ratings
FROM {src}"""


def ratings_long(src: str) -> str:
    return f"""ratings AS (
  SELECT 'Helpfulness' AS aspect, r_help AS rating FROM {src} WHERE r_help IS NOT NULL
  UNION ALL SELECT 'Ethical Considerations', r_eth FROM {src} WHERE r_eth IS NOT NULL
  UNION ALL SELECT 'Visual Faithfulness', r_vis FROM {src})"""


def rating_quality_sql() -> str:
    return f"""WITH {FLINE},\n{ratings_long('fline')}
SELECT aspect, {class_sql('rating')} AS rating_class, CAST(count(*) AS BIGINT) AS n_ratings
FROM ratings GROUP BY ALL"""


def rating_domain_sql() -> str:
    v = parse_sql("rating")
    return f"""WITH {FLINE},\n{ratings_long('fline')},
parsed AS (SELECT aspect, {v} AS v FROM ratings)
SELECT aspect, CASE WHEN v IS NULL THEN 'unparseable' WHEN isnan(v) THEN 'nan'
  WHEN v BETWEEN 1 AND 5 THEN 'in_scale' ELSE 'out_of_scale' END AS status,
  CAST(count(*) AS BIGINT) AS n_ratings
FROM parsed GROUP BY ALL"""


def completion_scores_sql() -> str:
    return f"WITH {FLINE},\n{scored('fline')}\nSELECT prompt_id, comp_idx, n_aspects, score FROM fline_scored"


def split_exact_sql() -> str:
    h = "md5('42:' || CAST(prompt_id AS VARCHAR) || ':' || CAST(comp_i AS VARCHAR) || ':' || CAST(comp_j AS VARCHAR))"
    return (
        FLINE_PAIRS
        + f""", hashed AS (SELECT prompt_id, comp_i, comp_j, {h} AS h FROM pairs),
ranked AS (SELECT *, row_number() OVER (ORDER BY h, prompt_id, comp_i, comp_j) AS rn FROM hashed)
SELECT prompt_id, comp_i, comp_j,
  CASE WHEN rn <= (SELECT CAST(ceil(0.005 * count(*)) AS BIGINT) FROM hashed) THEN 'test' ELSE 'train' END AS split
FROM ranked"""
    )


def split_by_content_sql() -> str:
    t = split.threshold_hex(catalog.CONTENT_TEST_SIZE)
    return f"""WITH RECURSIVE {FTEXT},
{scored('ftext')},
{pairs_cte('ftext')},
p AS (SELECT DISTINCT prompt_id, prompt_id // 3 AS img, CASE WHEN prompt_id % 5 = 0 THEN prompt ELSE prompt || ' #' || {s('prompt_id')} END AS t FROM ftext),
edge AS (
  SELECT a.prompt_id AS a, b.prompt_id AS b FROM p a JOIN p b ON a.t = b.t
  UNION SELECT a.prompt_id, b.prompt_id FROM p a JOIN p b ON a.img = b.img),
reach AS (SELECT prompt_id, prompt_id AS r FROM p UNION SELECT reach.prompt_id, edge.b FROM reach JOIN edge ON reach.r = edge.a),
grp AS (SELECT prompt_id, min(r) AS g FROM reach GROUP BY prompt_id)
SELECT prompt_id, comp_i, comp_j, CASE WHEN substr(md5('42:' || {s('g')}), 1, 8) < '{t}' THEN 'test' ELSE 'train' END AS split
FROM pairs JOIN grp USING (prompt_id)"""


def judge_loop_report_sql() -> str:
    """Enumerates the expected ratings and what each damage does to them."""
    return f"""WITH {FLINE},
e AS (SELECT prompt_id % 5 AS k, aspect, aspect <> 'Ethical Considerations' OR r_eth IS NOT NULL AS has
  FROM (SELECT prompt_id, r_eth, unnest([{', '.join(q(a) for a in annotate.ASPECT_HEADINGS)}]) AS aspect FROM fline)),
own AS (SELECT CASE WHEN k IN (0, 3) THEN 'no_answer' WHEN k = 1 THEN 'null_answer'
    WHEN k = 2 AND aspect = 'Helpfulness' THEN 'missing_section' WHEN has THEN 'ok' ELSE 'missing_block' END AS outcome FROM e),
more AS (SELECT CASE WHEN k = 3 THEN 'unknown_group' ELSE 'unknown_aspect' END AS outcome FROM e WHERE has AND (k = 3 OR k = 2 AND aspect = 'Helpfulness'))
SELECT outcome, count(*) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY outcome"""


def split_by_prompt_sql() -> str:
    t = split.threshold_hex(0.005)
    return (
        FLINE_PAIRS
        + f"""SELECT prompt_id, comp_i, comp_j,
  CASE WHEN substr(md5('42:' || CAST(prompt_id AS VARCHAR)), 1, 8) < '{t}' THEN 'test' ELSE 'train' END AS split
FROM pairs"""
    )


# ---------------------------------------------------------------- tokens and ChatML


def arr(values: list[int]) -> str:
    return "[" + ", ".join(str(int(v)) for v in values) + "]::INTEGER[]"


def cp_sql(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN []::INTEGER[] ELSE list_transform(string_split({t}, ''), lambda c: CAST(unicode(c) AS INTEGER)) END)"


def rep_sql(value: int, n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda i: CAST({int(value)} AS INTEGER))"


NL = TOK.encode_const("\n")
SYS_IDS, SYS_LAB = chatml.system_segment(TOK)
USER_HDR = TOK.role_ids("user") + NL
ASST_ROLE = TOK.role_ids("assistant")
TAIL = [CP_IM_END] + NL


def user_ids_sql(x: str) -> str:
    return f"list_concat({arr(USER_HDR)}, {x}, {arr(TAIL)})"


def user_lab_sql(x: str) -> str:
    return f"list_concat({arr([CP_IM_START])}, {rep_sql(IGNORE_INDEX, f'len({x}) + {len(USER_HDR) + len(TAIL) - 3}')}, {arr(TAIL)})"


def asst_ids_sql(x: str) -> str:
    return f"list_concat({arr(ASST_ROLE + NL)}, {x}, {arr(TAIL)})"


def asst_lab_sql(x: str) -> str:
    return f"list_concat({arr([CP_IM_START] + [IGNORE_INDEX] * len(ASST_ROLE))}, {x}, {arr(TAIL)})"


def digest_sql(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


CONV_NORM = """conv_norm AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn
    FROM conversations WHERE role IN ('user', 'assistant')) t
  WHERE NOT (turn = first_turn AND role <> 'user'))"""

TURNS = f"""{CONV_NORM},
turns AS (
  SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS seg_text,
    CASE WHEN role = 'user' THEN {user_ids_sql('x')} ELSE {asst_ids_sql('x')} END AS ids,
    CASE WHEN role = 'user' THEN {user_lab_sql('x')} ELSE {asst_lab_sql('x')} END AS labels
  FROM (SELECT *, {cp_sql('text')} AS x FROM conv_norm) c)"""

SYS_TEXT = q(chatml.system_text())

# a leading system turn is the conversation's own system segment, else the default one
OWN_SYSTEM = f"""own AS (
  SELECT conv_id, text AS sys FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM conversations) t
  WHERE turn = first_turn AND role = 'system'),
sysseg AS (
  SELECT conv_id, CASE WHEN sys IS NULL THEN {SYS_TEXT} ELSE '<|im_start|>system' || chr(10) || sys || '<|im_end|>' || chr(10) END AS sys_text,
    CASE WHEN sys IS NULL THEN {arr(SYS_IDS)} ELSE list_concat({arr([CP_IM_START] + TOK.encode_const('system') + NL)}, {cp_sql('sys')}, {arr(TAIL)}) END AS sys_ids,
    CASE WHEN sys IS NULL THEN {arr(SYS_LAB)}
      ELSE list_concat({arr([CP_IM_START])}, {rep_sql(IGNORE_INDEX, f'length(sys) + {len(TOK.encode_const("system")) + 1 + len(NL) + len(TAIL) - 3}')}, {arr(TAIL)}) END AS sys_lab
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN own USING (conv_id))"""


def chatml_render_system_sql() -> str:
    return f"""WITH {TURNS},
{OWN_SYSTEM},
r AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  any_value(sys_text) || string_agg(seg_text, '' ORDER BY turn) AS text,
  list_concat(any_value(sys_ids), flatten(list(ids ORDER BY turn))) AS ids,
  list_concat(any_value(sys_lab), flatten(list(labels ORDER BY turn))) AS labels
  FROM turns JOIN sysseg USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, text, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5 FROM r"""


def turn_prompts_system_sql() -> str:
    w = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {TURNS},
{OWN_SYSTEM},
r AS (SELECT conv_id, turn, role,
  sys_text || string_agg(seg_text, '') {w} AS prompt_text,
  list_concat(sys_ids, flatten(list(ids) {w})) AS ids,
  list_concat(sys_lab, flatten(list(labels) {w})) AS labels
  FROM turns JOIN sysseg USING (conv_id))
SELECT conv_id, turn, prompt_text, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5,
  {digest_sql(_mask_sql('ids'))} AS mask_md5
FROM r WHERE role = 'user'"""


def chatml_render_sql() -> str:
    return f"""WITH {TURNS},
r AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  {SYS_TEXT} || string_agg(seg_text, '' ORDER BY turn) AS text,
  list_concat({arr(SYS_IDS)}, flatten(list(ids ORDER BY turn))) AS ids,
  list_concat({arr(SYS_LAB)}, flatten(list(labels ORDER BY turn))) AS labels
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, text, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5 FROM r"""


def turn_prompts_sql() -> str:
    w = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {TURNS},
r AS (SELECT conv_id, turn, role,
  {SYS_TEXT} || string_agg(seg_text, '') {w} AS prompt_text,
  list_concat({arr(SYS_IDS)}, flatten(list(ids) {w})) AS ids,
  list_concat({arr(SYS_LAB)}, flatten(list(labels) {w})) AS labels
  FROM turns)
SELECT conv_id, turn, prompt_text, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5,
  {digest_sql(_mask_sql('ids'))} AS mask_md5
FROM r WHERE role = 'user'"""


def turn_answers_sql() -> str:
    return f"""WITH {TURNS}
SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5,
  {digest_sql(_mask_sql('ids'))} AS mask_md5
FROM turns WHERE role = 'assistant'"""


def encode_labels_sql() -> str:
    return f"""WITH {TURNS}
SELECT conv_id, turn, role, CAST(len(ids) AS BIGINT) AS n_ids, {digest_sql('ids')} AS ids_md5, {digest_sql('labels')} AS labels_md5,
  CAST(len(list_filter(labels, lambda v: v = {IGNORE_INDEX})) AS BIGINT) AS n_ignored
FROM turns"""


def drop_leading_sql() -> str:
    return f"WITH {CONV_NORM}\nSELECT conv_id, turn, role, text FROM conv_norm"


# ---------------------------------------------------------------- pair encoding


def _mask_sql(ids: str) -> str:
    pad, eos = TOK.pad_token_id, TOK.eos_token_id
    return f"list_transform({ids}, lambda v: CAST(CASE WHEN v = {eos} THEN 0 WHEN v <> {pad} THEN 1 ELSE 0 END AS INTEGER))"


def _head(a: str, n: int) -> str:
    return f"list_slice({a}, 1, {n})" if n > 0 else "[]::INTEGER[]"


def _tail(a: str, n: int) -> str:
    if n == 0:
        return a
    return f"list_slice({a}, greatest(1, len({a}) - {n} + 1), len({a}))"


def encoded_cte() -> str:
    mpl, ml = CFG.max_prompt_length, CFG.max_length
    keep = ml - mpl
    eos = TOK.eos_token_id
    cut = _tail if CFG.truncation_mode == "keep_end" else _head
    seq = ("ids", "lab", "mask")
    return f""", enc0 AS (
  SELECT prompt_id, comp_i, comp_j, prompt, chosen, rejected,
    list_concat({arr(SYS_IDS)}, {user_ids_sql(cp_sql('prompt'))}) AS p_ids,
    list_concat({arr(SYS_LAB)}, {user_lab_sql(cp_sql('prompt'))}) AS p_lab,
    {asst_ids_sql(cp_sql('chosen'))} AS c_ids0, {asst_lab_sql(cp_sql('chosen'))} AS c_lab0,
    {asst_ids_sql(cp_sql('rejected'))} AS r_ids0, {asst_lab_sql(cp_sql('rejected'))} AS r_lab0
  FROM pairs),
enc1 AS (
  SELECT *, {_mask_sql('p_ids')} AS p_mask,
    list_concat(c_ids0, [{eos}]::INTEGER[]) AS c_ids, list_concat(c_lab0, [{eos}]::INTEGER[]) AS c_lab,
    list_concat({_mask_sql('c_ids0')}, [1]::INTEGER[]) AS c_mask,
    list_concat(r_ids0, [{eos}]::INTEGER[]) AS r_ids, list_concat(r_lab0, [{eos}]::INTEGER[]) AS r_lab,
    list_concat({_mask_sql('r_ids0')}, [1]::INTEGER[]) AS r_mask
  FROM enc0),
enc2 AS (
  SELECT *, len(p_ids) AS prompt_len, greatest(len(c_ids), len(r_ids)) AS response_len,
    len(p_ids) + greatest(len(c_ids), len(r_ids)) > {ml} AS prompt_over
  FROM enc1),
enc3 AS (
  SELECT *, {", ".join(f"CASE WHEN prompt_over THEN {cut(f'p_{k}', mpl)} ELSE p_{k} END AS tp_{k}" for k in seq)}
  FROM enc2),
enc4 AS (
  SELECT *, len(tp_ids) AS prompt_len_after, len(tp_ids) + response_len > {ml} AS response_over FROM enc3),
enc AS (
  SELECT *, {", ".join(f"CASE WHEN response_over THEN {_head(f'{x}_{k}', keep)} ELSE {x}_{k} END AS t{x}_{k}" for x in ("c", "r") for k in seq)}
  FROM enc4),
final AS (
  SELECT prompt_id, comp_i, comp_j,
    list_concat(tp_ids, tc_ids) AS chosen_input_ids,
    list_concat({rep_sql(CFG.label_pad_token_id, 'prompt_len_after')}, tc_lab) AS chosen_labels,
    list_concat(tp_mask, tc_mask) AS chosen_attention_mask,
    list_concat(tp_ids, tr_ids) AS rejected_input_ids,
    list_concat({rep_sql(CFG.label_pad_token_id, 'prompt_len_after')}, tr_lab) AS rejected_labels,
    list_concat(tp_mask, tr_mask) AS rejected_attention_mask,
    tp_ids AS prompt_input_ids, tp_lab AS prompt_labels, tp_mask AS prompt_attention_mask,
    prompt || chosen AS chosen, prompt || rejected AS rejected
  FROM enc)
"""


ENC = FTEXT_PAIRS + encoded_cte()
SEQS = catalog.SEQS


def encode_pairs_sql() -> str:
    lens = ", ".join(f"CAST(len({c}) AS BIGINT) AS {c}_len" for c in SEQS if c.endswith("input_ids"))
    mds = ", ".join(f"{digest_sql(c)} AS {c}_md5" for c in SEQS)
    return ENC + f"SELECT prompt_id, comp_i, comp_j, {lens}, {mds}, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM final"


def encode_masks_sql() -> str:
    masks = [c for c in SEQS if c.endswith("attention_mask")]
    mds = ", ".join(f"{digest_sql(c)} AS {c}_md5" for c in masks)
    zs = ", ".join(f"CAST(len(list_filter({c}, lambda v: v = 0)) AS BIGINT) AS {c}_zeros" for c in masks)
    return ENC + f"SELECT prompt_id, comp_i, comp_j, {mds}, {zs} FROM final"


def truncate_pairs_sql() -> str:
    return ENC + """SELECT prompt_id, comp_i, comp_j, CAST(prompt_len AS BIGINT) AS prompt_len,
  CAST(response_len AS BIGINT) AS response_len, CAST(prompt_len_after AS BIGINT) AS prompt_len_after,
  CAST(len(tc_ids) AS BIGINT) AS chosen_len_after, CAST(len(tr_ids) AS BIGINT) AS rejected_len_after,
  CASE WHEN response_over THEN 'responses_truncated' WHEN prompt_over THEN 'prompt_truncated' ELSE 'fits' END AS "case"
FROM enc"""


def length_report_sql() -> str:
    inner = truncate_pairs_sql()
    return f"""SELECT "case", CAST(count(*) AS BIGINT) AS n_pairs, CAST(max(prompt_len) AS BIGINT) AS max_prompt_len,
  CAST(max(response_len) AS BIGINT) AS max_response_len,
  CAST(max(prompt_len_after + greatest(chosen_len_after, rejected_len_after)) AS BIGINT) AS max_total_after
FROM ({inner}) t GROUP BY "case\""""


def pad_batches_sql() -> str:
    bs = catalog.PAD_BATCH_SIZE
    h = "md5('42:' || CAST(prompt_id AS VARCHAR) || ':' || CAST(comp_i AS VARCHAR) || ':' || CAST(comp_j AS VARCHAR))"
    pads = {"input_ids": CP_EOD, "labels": IGNORE_INDEX, "attention_mask": 0}
    cols = []
    for side in ("prompt", "chosen", "rejected"):
        for k, v in pads.items():
            a = f"{side}_{k}"
            fill = rep_sql(v, f"{side}_width - len({a})")
            padded = f"list_concat({fill}, {a})" if side == "prompt" else f"list_concat({a}, {fill})"
            cols.append(f"{digest_sql(padded)} AS {a}_md5")
    return (
        ENC
        + f""", b1 AS (SELECT *, {h} AS h FROM final),
b2 AS (SELECT *, CAST((row_number() OVER (ORDER BY h, prompt_id, comp_i, comp_j) - 1) // {bs} AS BIGINT) AS batch FROM b1),
b3 AS (SELECT *,
  CAST(max(len(prompt_input_ids)) OVER (PARTITION BY batch) AS BIGINT) AS prompt_width,
  CAST(max(len(chosen_input_ids)) OVER (PARTITION BY batch) AS BIGINT) AS chosen_width,
  CAST(max(len(rejected_input_ids)) OVER (PARTITION BY batch) AS BIGINT) AS rejected_width FROM b2)
SELECT prompt_id, comp_i, comp_j, batch, prompt_width, chosen_width, rejected_width, {", ".join(cols)} FROM b3"""
    )


# ---------------------------------------------------------------- prompts, texts, annotation


def format_prompts_sql() -> str:
    return f"WITH {FTEXT}\nSELECT DISTINCT prompt_id, {img_prompt_sql('prompt', 'img_path')} AS prompt FROM ftext"


def make_conversations_sql() -> str:
    parts = []
    for side in ("chosen", "rejected"):
        parts.append(f"SELECT prompt_id, comp_i, comp_j, '{side}' AS side, CAST(0 AS BIGINT) AS turn, 'user' AS role, prompt AS value FROM pairs")
        parts.append(f"SELECT prompt_id, comp_i, comp_j, '{side}', CAST(1 AS BIGINT), 'assistant', {side} FROM pairs")
    return FTEXT_PAIRS + "\nUNION ALL\n".join(parts)


def full_texts_sql() -> str:
    return FTEXT_PAIRS + """SELECT prompt_id, comp_i, comp_j, prompt, prompt || chosen AS chosen, prompt || rejected AS rejected,
  chosen AS chosen_response_only, rejected AS rejected_response_only FROM pairs"""


def annotation_prompts_sql(src: str = "ftext", cte: str = FTEXT, out: str = "annotation_prompt") -> str:
    parts = annotate.template_parts()
    n = annotate.N_SLOTS
    texts = [f"max(CASE WHEN comp_idx % {n} = {i} THEN response END)" for i in range(n)]
    pieces = [q(parts[0]), "coalesce(any_value(prompt), '')"]
    for i in range(n):
        pieces += [q(parts[i + 1]), f"coalesce({texts[i]}, '')"]
    pieces.append(q(parts[-1]))
    text = " || ".join(pieces)
    filled = text if out == "annotation_prompt" else f"md5({text})"
    return f"""WITH {cte}
SELECT prompt_id, CAST(comp_idx // {n} AS BIGINT) AS group_idx, CAST(count(*) AS BIGINT) AS n_texts, {filled} AS {out}
FROM {src} GROUP BY prompt_id, comp_idx // {n}"""


def conversation_report_sql() -> str:
    return """WITH c AS (
  SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user,
    count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
    count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS n_other, count(*) FILTER (WHERE text IS NULL) AS n_null_text,
    arg_min(role, turn) FILTER (WHERE role IN ('user', 'assistant')) AS lead
  FROM conversations GROUP BY conv_id)
SELECT *  EXCLUDE (lead), CAST(coalesce(lead = 'assistant', false) AS BIGINT) AS n_leading,
  n_user + n_assistant - CAST(coalesce(lead = 'assistant', false) AS BIGINT) AS n_rendered FROM c"""


def parse_quarantine_sql() -> str:
    """Enumerates the expected blocks and what each damage does to them."""
    aspects = ", ".join(q(a) for a in annotate.ASPECT_HEADINGS)
    return f"""WITH {FTEXT},
e AS (SELECT prompt_id, prompt_id % 8 AS k, comp_idx + 1 AS i, unnest([{aspects}]) AS aspect FROM ftext),
own AS (
  SELECT prompt_id, i AS text_idx, aspect,
    CASE WHEN k = 1 THEN 'null_answer' WHEN k = 2 AND i = 2 THEN 'missing_block' WHEN k = 3 THEN 'no_rating_line'
         WHEN k = 4 AND aspect = 'Helpfulness' THEN 'missing_section' WHEN k = 6 AND i = 3 THEN 'missing_block' ELSE 'ok' END AS status FROM e),
more AS (
  SELECT prompt_id, CASE k WHEN 2 THEN 9 WHEN 6 THEN NULL ELSE i END AS text_idx, CASE WHEN k = 4 THEN 'Foo' ELSE aspect END AS aspect,
    CASE k WHEN 4 THEN 'unknown_aspect' WHEN 5 THEN 'duplicate' ELSE 'unknown_text' END AS status
  FROM e WHERE k = 5 OR k = 4 AND aspect = 'Helpfulness' OR k = 2 AND i = 2 OR k = 6 AND i = 3)
SELECT CAST(prompt_id AS BIGINT) AS prompt_id, CAST(0 AS BIGINT) AS group_idx, CAST(text_idx AS BIGINT) AS text_idx, aspect, status
FROM (SELECT * FROM own UNION ALL SELECT * FROM more)"""


def jsonl_quarantine_sql() -> str:
    return f"""WITH {FTEXT}, p AS (SELECT DISTINCT prompt_id, prompt_id % 7 AS k FROM ftext)
SELECT CASE WHEN k IN (0, 6) THEN 'ok' WHEN k = 5 THEN 'blank_line' ELSE 'malformed' END AS reason, count(*) AS n_lines,
  CAST(sum(CASE WHEN k IN (0, 6) THEN prompt_id ELSE 0 END) AS BIGINT) AS id_sum FROM p GROUP BY 1"""


def preference_table_sql() -> str:
    flat = flat_annotations_sql("ftext")
    return f"WITH {FTEXT}, f AS ({flat})\nSELECT *, unnest(['nested', 'parallel']) AS layout FROM f"


def split_without_ids_sql() -> str:
    return f"""{FTEXT_PAIRS.rstrip()},
twice AS (SELECT * FROM pairs UNION ALL SELECT * FROM pairs WHERE prompt_id % 3 = 0)
SELECT unnest(['nested', 'flat']) AS form, n_pairs, n_test, n_chars FROM (
  SELECT count(*) AS n_pairs, CAST(ceil(0.005 * count(*)) AS BIGINT) AS n_test,
    CAST(sum(length(prompt) + length(chosen) + 2 * length(rejected)) AS BIGINT) AS n_chars FROM twice)"""


def parse_annotations_sql() -> str:
    parts = []
    for aspect, col in (("Helpfulness", "r_help"), ("Ethical Considerations", "r_eth"), ("Visual Faithfulness", "r_vis")):
        ratio = "CASE WHEN {c} IS NULL THEN '' ELSE rationale END".format(c=col)
        parts.append(
            f"SELECT prompt_id, 0 AS group_idx, comp_idx + 1 AS text_idx, {q(aspect)} AS aspect, coalesce({col}, 'N/A') AS rating, {ratio} AS rationale FROM ftext"
        )
    return f"WITH {FTEXT}\nSELECT CAST(prompt_id AS BIGINT) AS prompt_id, CAST(group_idx AS BIGINT) AS group_idx, CAST(text_idx AS BIGINT) AS text_idx, aspect, rating, rationale FROM (\n" + "\nUNION ALL\n".join(parts) + ") t"


def sample_models_sql() -> str:
    k = catalog.SAMPLE_MODELS_K
    return f"""WITH {FLINE},
r AS (SELECT prompt_id, comp_idx, model,
  row_number() OVER (PARTITION BY prompt_id ORDER BY md5('42:' || CAST(prompt_id AS VARCHAR) || ':' || CAST(comp_idx AS VARCHAR)), comp_idx) AS rank
  FROM fline)
SELECT prompt_id, comp_idx, model, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {k}"""


def sample_by_domain_sql() -> str:
    k = catalog.SAMPLE_DOMAIN_K
    return f"""WITH r AS (SELECT source, doc_id,
  row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS rank
  FROM documents)
SELECT source, doc_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {k}"""


def jsonl_roundtrip_sql() -> str:
    return f"WITH {FTEXT}\n" + flat_annotations_sql("ftext")


ORACLE_SQL: dict[str, str] = {
    "build_pairs": FLINE_PAIRS + PAIR_SELECT,
    "build_pairs_join": FLINE_PAIRS + PAIR_SELECT,
    "build_pairs_text": FTEXT_PAIRS + PAIR_SELECT,
    "stream_pairs": FLINE_PAIRS + PAIR_SELECT,
    "stream_pairs_flat": FLINE_PAIRS + PAIR_SELECT,
    "pair_outcomes": pair_outcomes_sql(),
    "completion_scores": completion_scores_sql(),
    "unnest_completions": f"WITH {FLINE}\n" + flat_annotations_sql("fline"),
    "rating_quality": rating_quality_sql(),
    "rating_domain_check": rating_domain_sql(),
    "format_prompts": format_prompts_sql(),
    "make_conversations": make_conversations_sql(),
    "full_texts": full_texts_sql(),
    "split_exact": split_exact_sql(),
    "split_growing": split_exact_sql(),
    "split_by_content": split_by_content_sql(),
    "build_pairs_dealt": FLINE_PAIRS + PAIR_SELECT,
    "build_pairs_long": FLINE_PAIRS + PAIR_SELECT,
    "completion_scores_long": completion_scores_sql(),
    "judge_loop_pairs": FLINE_PAIRS + PAIR_SELECT,
    "judge_loop_report": judge_loop_report_sql(),
    "split_by_prompt": split_by_prompt_sql(),
    "jsonl_roundtrip": jsonl_roundtrip_sql(),
    "drop_leading_nonuser": drop_leading_sql(),
    "chatml_render": chatml_render_sql(),
    "turn_prompts": turn_prompts_sql(),
    "chatml_render_system": chatml_render_system_sql(),
    "turn_prompts_system": turn_prompts_system_sql(),
    "turn_answers": turn_answers_sql(),
    "encode_labels": encode_labels_sql(),
    "encode_pairs": encode_pairs_sql(),
    "stream_encode_pairs": encode_pairs_sql(),
    "encode_masks": encode_masks_sql(),
    "truncate_pairs": truncate_pairs_sql(),
    "length_report": length_report_sql(),
    "conversation_report": conversation_report_sql(),
    "jsonl_quarantine": jsonl_quarantine_sql(),
    "preference_table": preference_table_sql(),
    "split_without_ids": split_without_ids_sql(),
    "parse_quarantine": parse_quarantine_sql(),
    "annotation_prompts_line": annotation_prompts_sql("fline", FLINE, "prompt_md5"),
    "pad_batches": pad_batches_sql(),
    "annotation_prompts": annotation_prompts_sql(),
    "parse_annotations": parse_annotations_sql(),
    "sample_models": sample_models_sql(),
    "sample_by_domain": sample_by_domain_sql(),
}
