"""Building blocks of the SQL that checks the registered queries."""

from __future__ import annotations

# Written out here, so that a wrong entry in the functions shows.
CONTRACTED = "do=de o,da=de a,dos=de os,das=de as,no=em o,na=em a,nos=em os,nas=em as,pelo=por o,pela=por a,pelos=por os,pelas=por as,num=em um,numa=em uma,nums=em uns,numas=em umas,ao=a o,aos=a os,à=a a,às=a as"
STOPPED = """a ao aos aquela aquelas aquele aqueles aquilo as ate com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eramos eram essa essas esse esses esta estas
estavam estavamos este esteja estejam estejamos estes esteve estive estivemos estiver estivera estiveram estiveramos estiverem estivermos estivesse estivessem estivessemos estou eu foi fomos for fora foram
foramos forem formos fosse fossem fossemos fui ha haja hajam hajamos hao havemos hei houve houvemos houver houvera houveram houveramos houverem houvermos houvesse houvessem houvessemos isso isto ja lhe lhes
mais mas me mesmo meu meus minha minhas muito na nao nas nem no nos nossa nossas nosso nossos num numa o os ou para pela pelas pelo pelos por qual quando que quem sao se seja sejam sejamos sem serei
seremos seria seriam seriamos seu seus so somos sou sua suas tambem te tem temos tenha tenham tenhamos tenho tera terao terei teremos teria teriam teriamos teu teus teve tinha tinham tinhamos tive tivemos
tiver tivera tiveram tiveramos tiverem tivermos tivesse tivessem tivessemos tu tua tuas um uma voce voces vos"""
SOUNDS = "ss=s,rr=r,ll=l,ce=se,ci=si,ch=x,qu=k,ge=je,gi=ji,lh=l,nh=n"
CONTROL = r"'\\r\\n|\\rn|\\r|\\n|\\t|\r\n|\r|\n|\t'"


def expanded(x: str) -> str:
    out = f"(' ' || {x} || ' ')"
    for short, full in (x.split("=") for x in CONTRACTED.split(",")):
        out = f"replace({out}, ' {short} ', ' {full} ')"
    return f"trim({out})"


def folded(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


def cleaned(x: str) -> str:
    low = f"lower(regexp_replace({x}, {CONTROL}, ' ', 'g'))"
    kept = f"regexp_replace({folded(expanded(low))}, '[^a-z0-9\\s$<>:.\\-]', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '(<[^>]+>|[\\w\\-]+)')"


def kept_tokens(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOPPED.split())
    return f"list_filter({x}, lambda t: t NOT IN ({words}) OR starts_with(t, '<'))"


def prepared(x: str) -> str:
    return f"array_to_string({kept_tokens(tokens(cleaned(x)))}, ' ')"


def single_spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sounds(x: str) -> str:
    out = f"lower({folded(x)})"
    for pair, sound in (x.split("=") for x in SOUNDS.split(",")):
        out = f"replace({out}, '{pair}', '{sound.upper()}')"
    return f"regexp_replace(lower(replace(replace({out}, 'c', 'k'), 'h', '')), 'm( |$)', 'n\\1', 'g')"


def counts(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in `name` (key, term, tf): words and word pairs of a prepared text."""
    return f"""
{name}_w AS (SELECT {key}, regexp_extract_all(lower({text}), '\\b\\w\\w+\\b') AS w FROM {source}),
{name}_t AS (SELECT {key}, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w),
{name} AS (SELECT {key}, term, count(*) AS tf FROM {name}_t GROUP BY ALL)"""


def tfidf(cands: str = "cands", queries: str | None = "qs") -> str:
    """CTEs ending in `vec` (term, pos, w) and, with queries, `scores` (query_id, pos, score)."""
    out = f"""{counts(cands, "pos", "p", "ct")},
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {cands})) / (1.0 + count(*))) + 1 AS idf FROM ct GROUP BY term),
rw AS (SELECT term, pos, tf * idf AS r FROM ct JOIN idf USING (term)),
vec AS (SELECT term, pos, r / sqrt(sum(r * r) OVER (PARTITION BY pos)) AS w FROM rw)"""
    if queries:
        out += f""",{counts(queries, "query_id", "p", "qt")},
qr AS (SELECT term, query_id, tf * idf AS r FROM qt JOIN idf USING (term)),
qv AS (SELECT term, query_id, r / sqrt(sum(r * r) OVER (PARTITION BY query_id)) AS q FROM qr),
scores AS (SELECT query_id, pos, sum(w * q) AS score FROM vec JOIN qv USING (term) GROUP BY ALL)"""
    return out


def bm25(k1: float, b: float, cands: str = "cands", queries: str = "qs") -> str:
    """CTEs ending in `scores` (query_id, pos, score), not normalised."""
    return f"""
bt AS (SELECT pos, list_filter(string_split(p, ' '), lambda t: t <> '') AS w FROM {cands}),
bx AS (SELECT pos, len(w) AS dl, unnest(w) AS term FROM bt),
bc AS (SELECT pos, term, any_value(dl) AS dl, count(*) AS tf FROM bx GROUP BY pos, term),
bs AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM bt),
bd AS (SELECT term, count(*) AS df FROM bc GROUP BY term),
bw AS (SELECT term, pos, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / greatest(avgdl, 1e-10))) AS w
       FROM bc JOIN bd USING (term), bs),
bq AS (SELECT query_id, unnest(list_filter(string_split(p, ' '), lambda t: t <> '')) AS term FROM {queries}),
scores AS (SELECT query_id, pos, sum(w) AS score FROM bw JOIN bq USING (term) GROUP BY ALL)"""


def topped(n: int, least: float, scores: str = "scores") -> str:
    return f"""best AS (SELECT query_id, pos, score, rank FROM (SELECT query_id, pos, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS INTEGER) AS rank FROM {scores} WHERE round(score, 9) >= {least}) WHERE rank <= {n})"""


def common_length(pairs: str, name: str = "lcs") -> str:
    """CTEs ending in `name` (a, b, n): longest common subsequence of the distinct pairs (a, b)."""
    return f"""
{name}_r AS (SELECT a, b, 0 AS i, list_transform(range(1, length(b) + 2), lambda j: 0) AS r FROM (SELECT DISTINCT a, b FROM {pairs})
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1),
    lambda q: CASE WHEN q = 1 THEN 0 ELSE greatest(r[q], r[q - 1] + CAST(substr(a, i + 1, 1) = substr(b, q - 1, 1) AS INTEGER)) END)))
  FROM {name}_r WHERE i < length(a)),
{name} AS (SELECT a, b, r[length(b) + 1] AS n FROM {name}_r WHERE i = length(a))"""


def ratio(name: str, a: str = "a", b: str = "b") -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0 * {name}.n / (length({a}) + length({b})) END)"


def pair_cosine(pairs: str) -> str:
    """CTEs ending in `pc` (a, b, cosine) over the distinct pairs (a, b)."""
    return f"""
pk AS (SELECT row_number() OVER () AS k, a, b FROM (SELECT DISTINCT a, b FROM {pairs})),{counts("pk", "k", "a", "pa")},{counts("pk", "k", "b", "pb")},
pf AS (SELECT k, coalesce(pa.tf, 0) AS x, coalesce(pb.tf, 0) AS y, CASE WHEN pa.tf IS NULL OR pb.tf IS NULL THEN 1 + ln(1.5) ELSE 1.0 END AS idf FROM pa FULL JOIN pb USING (k, term)),
pg AS (SELECT k, sum(x * y * idf * idf) AS d, sqrt(sum(x * x * idf * idf)) AS u, sqrt(sum(y * y * idf * idf)) AS v FROM pf GROUP BY k),
pc AS (SELECT a, b, coalesce(CASE WHEN u > 0 AND v > 0 THEN d / (u * v) END, 0.0) AS cosine FROM pk LEFT JOIN pg USING (k))"""


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_vectors(source: str, key: str, name: str) -> str:
    """CTEs ending in `name` (key, v): unit vectors of the counts of LETTERS in the prepared texts p of a source."""
    counted = f"list_transform(string_split('{LETTERS}', ''), lambda c: CAST(length(p) - length(replace(p, c, '')) AS DOUBLE))"
    return f"""
{name}_c AS (SELECT {key}, {counted} AS c FROM {source}),
{name}_n AS (SELECT {key}, c, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-10) AS n FROM {name}_c),
{name} AS (SELECT {key}, list_transform(c, lambda x: CAST(CAST(x / n AS FLOAT) AS DOUBLE)) AS v FROM {name}_n)"""


def dense(cands: str = "cands", queries: str = "qs") -> str:
    """CTEs ending in `scores` (query_id, pos, score): clipped inner products of letter vectors."""
    return f"""{letter_vectors(cands, "pos", "cv")},{letter_vectors(queries, "query_id", "qw")},
scores AS (SELECT query_id, pos, greatest(0.0, least(1.0, list_dot_product(qw.v, cv.v))) AS score FROM qw, cv)"""
