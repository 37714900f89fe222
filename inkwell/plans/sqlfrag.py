"""DuckDB SQL fragments shared by the oracle queries (same semantics as
``inkwell.functions.text``)."""

# Python white space (str.isspace) for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda x: x <> '')"


def word_count(t: str) -> str:
    return f"CAST(len({words(t)}) AS BIGINT)"


def space_word_count(t: str) -> str:
    return f"CAST(len(string_split({t}, ' ')) AS BIGINT)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def fold(t: str) -> str:
    return f"array_to_string({words(t)}, ' ')"


LABELLED_DOCS = """(SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS result, d.lang, d.source,
        d.lang AS dataset, d.source AS generator
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

LABELLED_CONV = """(SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, text,
        CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS result
   FROM conversations WHERE role IN ('user', 'assistant'))"""


def auroc_sql(scored: str, group: list[str], score: str = "score", label: str = "label") -> str:
    """AUROC per group from a (group..., score, label) relation."""
    g = ", ".join(group)
    gsel = (g + ", ") if g else ""
    part = f"PARTITION BY {g}" if g else ""
    return f"""
WITH s AS (SELECT {gsel}CAST({score} AS DOUBLE) AS score, CAST({label} AS INTEGER) AS label
           FROM {scored} WHERE {score} IS NOT NULL AND {label} IN (0, 1)),
a AS (SELECT {gsel}score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS npos,
             SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nneg
      FROM s GROUP BY {gsel}score),
c AS (SELECT *, SUM(npos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(npos) OVER ({part}) AS P, SUM(nneg) OVER ({part}) AS N FROM a)
SELECT {gsel}CASE WHEN MAX(P) > 0 AND MAX(N) > 0
            THEN ROUND(SUM(nneg * (tp - npos / 2.0)) / (MAX(P) * MAX(N)), 6) END AS auroc,
       CAST(MAX(P) AS BIGINT) AS n_pos, CAST(MAX(N) AS BIGINT) AS n_neg
FROM c {"GROUP BY " + g if g else ""}"""


def md5_key(id_expr: str, seed) -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


def frac_split_sql(src: str, cls: str, idc: str, frac: float, seed, out: str) -> str:
    """CTEs assigning ``is_test`` by a stratified fraction split of ``src``
    (largest remainder over classes, ceil of the float product)."""
    return f"""
{out}_n AS (SELECT {cls} AS cls, COUNT(*) AS cnt FROM {src} GROUP BY {cls}),
{out}_t AS (SELECT cls, cnt, SUM(cnt) OVER () AS nn,
                CAST(CEIL(CAST(SUM(cnt) OVER () AS DOUBLE) * CAST({frac!r} AS DOUBLE)) AS BIGINT) AS tt
            FROM {out}_n),
{out}_e AS (SELECT *, tt * cnt / nn AS ex FROM {out}_t),
{out}_f AS (SELECT *, CAST(FLOOR(ex) AS BIGINT) AS fl, ex - FLOOR(ex) AS rem FROM {out}_e),
{out}_g AS (SELECT *, tt - SUM(fl) OVER () AS lft,
                ROW_NUMBER() OVER (ORDER BY rem DESC, cls) AS r FROM {out}_f),
{out}_k AS (SELECT cls, fl + CASE WHEN r <= lft THEN 1 ELSE 0 END AS take FROM {out}_g),
{out} AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.{cls} ORDER BY {md5_key('s.' + idc, seed)}, s.{idc})
                 <= k.take AS is_test
          FROM {src} s JOIN {out}_k k ON s.{cls} = k.cls)"""


def sql_str(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr)."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def detokenise(t: str) -> str:
    from inkwell.functions.text import DETOKENISE_RULES
    e = t
    for old, new in DETOKENISE_RULES:
        e = f"replace({e}, {sql_str(old)}, {sql_str(new)})"
    return strip(e)


def remove_tags(t: str) -> str:
    from inkwell.functions.text import PROMPT_TAGS
    e = t
    for tag in PROMPT_TAGS:
        e = f"replace({e}, {sql_str(tag)}, '')"
    return e


def reduce_words_sql(src: str, idc: str, textc: str, max_words: int, out: str) -> str:
    """CTEs: E14 line-keeping word budget of ``src.textc`` as ``out(id, text)``."""
    return f"""
{out}_l AS (SELECT {idc} AS id, UNNEST(string_split({textc}, chr(10))) AS line,
                   generate_subscripts(string_split({textc}, chr(10)), 1) AS i FROM {src}),
{out}_w AS (SELECT id, i, {words('line')} AS w FROM {out}_l),
{out}_c AS (SELECT id, i, w, COALESCE(SUM(len(w)) OVER (PARTITION BY id ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {out}_w),
{out} AS (SELECT id, string_agg(array_to_string(w[1:{max_words} - before], ' '), chr(10) ORDER BY i) AS text
          FROM {out}_c WHERE before < {max_words} GROUP BY id)"""


def pr_auc_sql(scored: str, group: list[str], score: str = "score", label: str = "label") -> str:
    """PR AUC (trapezoid, anchored at recall 0 / precision 1) per group."""
    g = ", ".join(group)
    gsel = (g + ", ") if g else ""
    part = f"PARTITION BY {g}" if g else ""
    return f"""
WITH s AS (SELECT {gsel}CAST({score} AS DOUBLE) AS score, CAST({label} AS INTEGER) AS label
           FROM {scored} WHERE {score} IS NOT NULL AND {label} IN (0, 1)),
a AS (SELECT {gsel}score, SUM(label) AS npos, SUM(1 - label) AS nneg FROM s GROUP BY {gsel}score),
c AS (SELECT *, SUM(npos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(nneg) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             SUM(npos) OVER ({part}) AS P FROM a)
SELECT {gsel}CASE WHEN MAX(P) > 0 THEN SUM(npos / P * (tp / (tp + fp)
          + CASE WHEN tp - npos + fp - nneg = 0 THEN 1.0
                 ELSE (tp - npos) / (tp - npos + fp - nneg) END) / 2.0) END AS pr_auc
FROM c {"GROUP BY " + g if g else ""}"""
