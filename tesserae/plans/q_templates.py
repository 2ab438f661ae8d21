"""Templates, their labels, images and frames in prompts, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import templates as M
from tesserae.operators import training as T
from tesserae.sources.readers import table

#: A template of every style, with parts that show where each of them goes.
PROBES = {name: M.Template(name, ("<U>", "<A>"), "<sep>", "<sep2>", "<sys>{message}", "be brief") for name in M.STYLES}
FAMILIES = {"generic": M.Template("add_colon_two", ("USER", "ASSISTANT"), " ", "</s>", "{message}", "be brief"), "mpt": M.TEMPLATES["Hermes-2"], "phi3": M.TEMPLATES["phi3-chat"], "internlm": M.TEMPLATES["internlm2-chat"]}
LONGEST = 4096


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Conversations in which human and gpt speak in turn, from the first human one."""
    c = table(s, d, "conversation").where(F.size("conversations") > 0).select("row_id", "image", "video", T.from_first_human(F.col("conversations")).alias("t"))
    return c.where(T.alternates(F.col("t")) & (F.size("t") > 0) & F.forall("t", lambda x: x["value"].isNotNull()))


def separator_styles(s: SparkSession, d: str) -> DataFrame:
    """Every conversation in every style."""
    texts = F.array(*[F.struct(F.lit(name).alias("style"), M.rendered(F.col("t"), p).alias("text")) for name, p in PROBES.items()])
    return _turns(s, d).select("row_id", F.explode(texts).alias("x")).select("row_id", "x.style", "x.text")


def registered_templates(s: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(name).alias("template"), M.rendered(F.col("t"), p).alias("text")) for name, p in M.TEMPLATES.items()])
    return _turns(s, d).select("row_id", F.explode(texts).alias("x")).select("row_id", "x.template", "x.text")


def template_labels(s: SparkSession, d: str) -> DataFrame:
    """Ids and labels of every conversation in the four families."""
    c = _turns(s, d)
    parts = [c.select("row_id", F.lit(name).alias("family"), M.masked(M.rendered(F.col("t"), p), name, p, LONGEST).alias("m")) for name, p in FAMILIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("row_id", "family", "m.ids", "m.labels")


def image_prompts(s: SparkSession, d: str) -> DataFrame:
    """First prompts with a mark for every picture, or a line for every frame of a video, and the marks filled."""
    c = _turns(s, d).select("row_id", F.col("t")[0]["value"].alias("v"), F.coalesce(F.greatest(F.size("image"), F.lit(0)), F.lit(0)).alias("n"), "video")
    marked = F.when(F.col("video").isNotNull(), F.concat(M.frames_mark(F.lit(4)), F.lit("\n"), F.regexp_replace("v", "<(image|video)>\\n?", ""))).when(F.col("n") > 0, T.with_image_mark(F.col("v"))).otherwise(F.col("v"))
    sizes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i + 1)
    return c.select("row_id", M.expand_images(marked, sizes).alias("prompt"))


def fixed_padding(s: SparkSession, d: str) -> DataFrame:
    """Word lengths of answers, filled up to 12 on either side."""
    p = table(s, d, "prediction").where("answer is not null").select("pred_id", F.transform(F.split("answer", " "), lambda w: F.length(w)).alias("ids"))
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("pred_id", j(M.padded_to(F.col("ids"), 12, 0)).alias("right"), j(M.padded_to(F.col("ids"), 12, 0, left=True)).alias("left"))


def ragged_grids(s: SparkSession, d: str) -> DataFrame:
    """Matrices of word lengths of an answer's lines, filled up to 6 by 8."""
    p = table(s, d, "prediction").where("answer is not null").select("pred_id", F.transform(F.split("answer", "\n"), lambda x: F.transform(F.split(x, " "), lambda w: F.length(w).cast("double"))).alias("g"))
    z = M.zero_padded(F.col("g"), F.lit(6), F.lit(8))
    return p.select("pred_id", F.array_join(F.transform(z, lambda r: F.array_join(F.transform(r, lambda x: x.cast("int").cast("string")), " ")), "/").alias("grid"))


QUERIES = {f.__name__: f for f in (separator_styles, registered_templates, template_labels, image_prompts, fixed_padding, ragged_grids)}

_T = """c AS (SELECT row_id, image, video, CASE WHEN conversations[1].from_role = 'system' THEN conversations[2:] ELSE conversations END AS t FROM conversation WHERE len(conversations) > 0),
  b AS (SELECT row_id, image, video, CASE WHEN t[1].from_role <> 'human' THEN t[2:] ELSE t END AS t FROM c),
  t AS (SELECT * FROM b WHERE len(t) > 0 AND len(list_filter(t, lambda x, i: x.from_role <> CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END OR x.value IS NULL)) = 0)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _style(lead: str, piece: str, bare: str) -> str:
    return f"{lead} || array_to_string(list_transform(t, lambda x, i: CASE WHEN x.value = '' THEN {bare} ELSE {piece} END), '')"


_R, _V, _E = "CASE WHEN i % 2 = 1 THEN '<U>' ELSE '<A>' END", "x.value", "CASE WHEN i % 2 = 1 THEN '<sep>' ELSE '<sep2>' END"
_NL, _S = "chr(10)", "'<sys>be brief'"
_ROUND = "CASE WHEN i % 2 = 1 THEN '[Round ' || ((i - 1) // 2) || ']<sep>' ELSE '' END"
#: The styles once more, as SQL: what leads, a message, a role alone.
_STYLES = {
    "add_colon_single": (f"{_S} || '<sep>'", f"{_R} || ': ' || {_V} || '<sep>'", f"{_R} || ':'"),
    "add_colon_two": (f"{_S} || '<sep>'", f"{_R} || ': ' || {_V} || {_E}", f"{_R} || ':'"),
    "add_colon_space_single": (f"{_S} || '<sep>'", f"{_R} || ': ' || {_V} || '<sep>'", f"{_R} || ': '"),
    "no_colon_single": (_S, f"{_R} || {_V} || '<sep>'", _R),
    "no_colon_two": (_S, f"{_R} || {_V} || {_E}", _R),
    "add_new_line_single": (f"{_S} || '<sep>'", f"{_R} || {_NL} || {_V} || '<sep>'", f"{_R} || {_NL}"),
    "llama2": (_S, f"CASE WHEN i = 1 THEN {_V} || ' ' ELSE {_R} || ' ' || {_V} || {_E} END", _R),
    "chatglm": (f"{_S} || '<sep>'", f"{_ROUND} || {_R} || '：' || {_V} || '<sep>'", f"{_ROUND} || {_R} || '：'"),
    "chatml": (f"{_S} || '<sep>' || {_NL}", f"{_R} || {_NL} || {_V} || '<sep>' || {_NL}", f"{_R} || {_NL}"),
    "chatintern": (_S, f"{_R} || ':' || {_V} || {_E} || {_NL}", f"{_R} || ':'"),
    "dolly": (_S, f"{_R} || ':' || {_NL} || {_V} || {_E} || CASE WHEN i % 2 = 0 THEN {_NL} || {_NL} ELSE '' END", f"{_R} || ':' || {_NL}"),
    "rwkv": (_S, f"{_R} || ': ' || replace(replace({_V}, chr(13) || {_NL}, {_NL}), {_NL} || {_NL}, {_NL}) || {_NL} || {_NL}", f"{_R} || ':'"),
    "phoenix": (_S, f"{_R} || ': <s>' || {_V} || '</s>'", f"{_R} || ': <s>'"),
    "robin": (f"{_S} || '<sep>'", f"{_R} || ':' || {_NL} || {_V} || '<sep>'", f"{_R} || ':' || {_NL}"),
    "falcon_chat": (f"{_S} || '<sep>'", f"{_R} || ': ' || {_V} || '<sep>'", f"{_R} || ':'"),
    "chatglm3": (_S, f"{_R} || {_NL} || ' ' || {_V}", _R),
    "internvl_zh": ("'be brief<sep2>'", f"{_R} || ': ' || {_V} || CASE WHEN i % 2 = 1 THEN '<sep2>' ELSE '<sep>' END", f"{_R} || ':'"),
    "mpt": (f"{_S} || '<sep>'", f"{_R} || {_V} || '<sep>'", _R),
}
_PAD = "CASE WHEN len(ids) < 12 THEN list_transform(range(12 - len(ids)), lambda i: 0) ELSE [] END"

SQL = {
    "separator_styles": f"WITH {_T} SELECT row_id, x.s AS style, x.t AS text FROM (SELECT row_id, unnest([{', '.join(f"{{'s': '{k}', 't': {_style(*v)}}}" for k, v in _STYLES.items())}]) AS x FROM t)",
    "registered_templates": f"""WITH {_T}, p AS (SELECT * FROM (VALUES ('Hermes-2', '<|im_start|>system' || {_NL} || {_quoted(M.TEMPLATES['Hermes-2'].message)} || '<|im_end|>', '<|im_start|>user' || {_NL}, '<|im_start|>assistant' || {_NL}, '<|im_end|>', '<|im_end|>'),
      ('internlm2-chat', '<|im_start|>system' || {_NL} || {_quoted(M.TEMPLATES['Hermes-2'].message)} || '<|im_end|>', '<|im_start|>user' || {_NL}, '<|im_start|>assistant' || {_NL}, '<|im_end|>', '<|im_end|>'),
      ('phi3-chat', '<|system|>' || {_NL} || {_quoted(M.TEMPLATES['Hermes-2'].message)} || '<|end|>', '<|user|>' || {_NL}, '<|assistant|>' || {_NL}, '<|end|>', '<|end|>'), ('internvl_zh', ' ', '<human>: ', '<bot>: ', ' ', '</s>')) v(template, lead, u, a, e1, e2))
      SELECT row_id, template, lead || array_to_string(list_transform(t, lambda x, i: CASE WHEN x.value = '' THEN CASE WHEN template = 'internvl_zh' THEN rtrim(CASE WHEN i % 2 = 1 THEN u ELSE a END) ELSE CASE WHEN i % 2 = 1 THEN u ELSE a END END ELSE CASE WHEN i % 2 = 1 THEN u || x.value || e1 ELSE a || x.value || e2 END END), '') AS text FROM t, p""",
    "image_prompts": f"""WITH {_T}, v AS (SELECT row_id, t[1].value AS v, coalesce(len(image), 0) AS n, video FROM t), m AS (SELECT row_id, CASE WHEN video IS NOT NULL THEN 'Frame1: <image>' || {_NL} || 'Frame2: <image>' || {_NL} || 'Frame3: <image>' || {_NL} || 'Frame4: <image>' || {_NL} || regexp_replace(v, '<(image|video)>\\n?', '', 'g')
      WHEN n > 0 AND NOT contains(v, '<image>') THEN '<image>' || {_NL} || v ELSE v END AS m FROM v), p AS (SELECT row_id, string_split(m, '<image>') AS p FROM m)
      SELECT row_id, p[1] || array_to_string(list_transform(p[2:], lambda x, i: CASE WHEN i <= 4 THEN '<img>' || repeat('<IMG_CONTEXT>', CAST(i + 1 AS INT)) || '</img>' ELSE '<image>' END || x), '') AS prompt FROM p""",
    "fixed_padding": f"""WITH p AS (SELECT pred_id, list_transform(string_split(answer, ' '), lambda w: length(w)) AS ids FROM prediction WHERE answer IS NOT NULL)
      SELECT pred_id, array_to_string(list_concat(ids, {_PAD}), ',') AS "right", array_to_string(list_concat({_PAD}, ids), ',') AS "left" FROM p""",
    "ragged_grids": """WITH p AS (SELECT pred_id, list_transform(string_split(answer, chr(10)), lambda x: list_transform(string_split(x, ' '), lambda w: length(w))) AS g FROM prediction WHERE answer IS NOT NULL),
      w AS (SELECT pred_id, list_transform(g, lambda r: array_to_string(list_concat(r, list_transform(range(greatest(8 - len(r), 0)), lambda i: 0)), ' ')) AS g FROM p)
      SELECT pred_id, array_to_string(list_concat(g, list_transform(range(greatest(6 - len(g), 0)), lambda i: '0 0 0 0 0 0 0 0')), '/') AS grid FROM w""",
}
