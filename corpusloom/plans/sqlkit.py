"""Pieces of DuckDB SQL that the twins of the queries are made of."""

from __future__ import annotations

from corpusloom.functions.constants import BINARY_SUFFIXES, LANGUAGE_WORDS, STOP, TOPIC_KEYWORDS
from corpusloom.functions.text import SPACE

Q3 = "tion ther thon"
Q1 = "the"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(x: str, language: str = "en") -> str:
    stop = ",".join(map(lit, STOP[language]))
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({x},''), '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9_\\-]+'), lambda w: translate(lower(w),'áéíóúüñ','aeiouun')), "
        f"lambda w: regexp_full_match(w,'[a-z]{{3,}}') AND w NOT IN ({stop}))")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def compact(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '\\x01|\\n+'), lambda s: {strip('s')}), lambda s: length(s) > 0)"


URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def canonical(x: str) -> str:
    u = strip(x)
    g = lambda k: f"regexp_extract({u}, '{URL}', {k})"
    path = f"regexp_replace(regexp_replace({g(3)}, ';[^/]*$', ''), '/+', '/', 'g')"
    return (
        f"CASE WHEN lower({g(1)}) IN ('http','https') AND {g(2)} <> '' THEN lower({g(1)}) || '://' || {g(2)} || "
        f"CASE WHEN {path} IN ('','/') THEN '/' ELSE regexp_replace({path}, '/$', '') END END")


def domain(x: str) -> str:
    return f"lower(regexp_extract({strip(x)}, '{URL}', 2))"


def url_path(x: str) -> str:
    return f"regexp_extract({strip(x)}, '{URL}', 3)"


def lang_code(x: str) -> str:
    return f"nullif(regexp_extract(replace(lower({strip(f'coalesce({x},{lit(str())})')}), '_', '-'), '^([a-z]{{2,3}})', 1), '')"


def lang_url(x: str) -> str:
    h = f"regexp_extract({domain(x)}, '^([a-z]{{2,3}})(-[a-z]{{2,3}})?\\.', 1)"
    p = f"regexp_extract(lower({url_path(x)}), '^/([a-z]{{2,3}})(-[a-z]{{2,3}})?(/|$)', 1)"
    return f"coalesce(nullif({h},''), nullif({p},''))"


def lang_text(x: str) -> str:
    w = f"regexp_extract_all(lower(substr(coalesce({x},''),1,5000)), '[a-záéíóúñü]+')"
    n = {k: f"len(list_intersect(list_distinct({w}), [{','.join(map(lit, v))}]))" for k, v in LANGUAGE_WORDS.items()}
    return f"CASE WHEN len({w}) < 40 THEN NULL WHEN {n['en']} >= 4 AND {n['en']} > {n['es']} THEN 'en' WHEN {n['es']} >= 4 AND {n['es']} > {n['en']} THEN 'es' END"


def relevance(title: str, text: str, url: str) -> str:
    blob = f"lower(coalesce({title},'') || ' ' || substr(coalesce({text},''),1,5000) || ' ' || coalesce({url},''))"
    return f"CAST(len(list_filter([{','.join(map(lit, TOPIC_KEYWORDS))}], lambda k: contains({blob}, k))) AS DOUBLE)"


def file_type(u: str, s: str) -> str:
    u, s = f"lower(coalesce({u},''))", f"lower(coalesce({s},''))"
    return (
        f"CASE WHEN contains({s},'pdf') OR {u} LIKE '%.pdf' OR contains({u},'.pdf?') THEN 'PDF' WHEN regexp_matches({u}, '\\.(jpe?g|png|gif|webp|svg)$') THEN 'IMAGEN' "
        f"WHEN regexp_matches({u}, '\\.mp4|\\.webm|\\.mov|youtube\\.com/watch') THEN 'VIDEO' ELSE 'DOCUMENTO' END")


BINARY = r"(?i)\.(" + "|".join(BINARY_SUFFIXES) + r")$"


def last_at(x: str, mark: str) -> str:
    return f"CASE WHEN strpos(reverse({x}), {lit(mark[::-1])}) = 0 THEN -1 ELSE length({x}) - strpos(reverse({x}), {lit(mark[::-1])}) - {len(mark) - 1} END"


def html_text(x: str) -> str:
    for tag in ("script", "style", "noscript", "svg"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return strip(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g')")


HASH_IDX = "CAST(('0x' || substr(sha1(term),7,2) || substr(sha1(term),5,2) || substr(sha1(term),3,2) || substr(sha1(term),1,2)) AS UBIGINT) % 384"
HASH_SIGN = "CASE WHEN substr(sha1(term),10,1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END"

HREF = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"


def join_root(base: str, link: str) -> str:
    """A link of the test pages, all of which are absolute paths, against the page's URL."""
    return f"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || {link}"


def cascade(rows: str, old: str = "FALSE", may: str = "TRUE", fetched: str = "CAST(NULL AS VARCHAR)", cap: int = 120, chars: int = 300) -> str:
    """``page_id, outcome`` and more of ``rows``; ``old`` and ``may`` are told of a row ``u`` of distinct URLs, ``fetched`` of a page."""
    return f"""WITH u0 AS (SELECT canonical, min(page_id) AS first, min(domain) AS site FROM {rows} WHERE canonical IS NOT NULL GROUP BY 1),
u1 AS (SELECT *, {old} AS old, {may} AS may FROM u0 u),
u2 AS (SELECT *, count(*) FILTER (WHERE NOT old AND may) OVER (PARTITION BY site ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u1),
u3 AS (SELECT canonical, first, CASE WHEN old THEN 'already_in_output' WHEN before >= {cap} THEN 'domain_limit' WHEN NOT may THEN 'blocked_by_robots' END AS barred FROM u2),
v AS (SELECT e.*, first, barred, {fetched} AS fetched FROM {rows} e LEFT JOIN u3 USING (canonical)),
c AS (SELECT *, min(page_id) FILTER (WHERE barred IS NULL AND first = page_id AND fetched IS NULL AND length(text) >= {chars}) OVER (PARTITION BY text_hash) AS leader FROM v)
SELECT *, CASE WHEN canonical IS NULL THEN 'bad_url' WHEN barred IS NOT NULL THEN barred WHEN first <> page_id THEN 'already_visited' WHEN fetched IS NOT NULL THEN fetched WHEN length(text) < {chars} THEN 'too_short' WHEN page_id IS DISTINCT FROM leader THEN 'duplicate_text' WHEN relevance_score <= 0 THEN 'low_relevance' ELSE 'written' END AS outcome FROM c"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), "SELECT doc_id, split_part(coalesce(text,''), chr(10), 1) AS title, coalesce(text,'') AS text, 'https://'||source||'.example.com/'||lang||'/'||CAST(doc_id AS VARCHAR) AS url, lang AS language, source||'.example.com' AS domain, 'webpage' AS source_type FROM documents"),
    "toks": (("corpus",), f"SELECT doc_id, title, text, url, {tok('text')} AS body, {tok('title')} AS head FROM corpus"),
    "post": (("toks",), "SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(body) AS term FROM toks) GROUP BY ALL"),
    "df": (("post",), "SELECT term, CAST(count(*) AS BIGINT) AS df FROM post GROUP BY term"),
    "nn": (("post",), "SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM post"),
    "fields": (("toks",), "SELECT doc_id, term, CAST(sum(b) AS BIGINT) AS tf_body, CAST(sum(1-b) AS BIGINT) AS tf_title FROM (SELECT doc_id, unnest(body) AS term, 1 AS b FROM toks UNION ALL SELECT doc_id, unnest(head), 0 FROM toks) GROUP BY doc_id, term"),
    "df2": (("fields",), "SELECT term, CAST(count(*) AS BIGINT) AS df FROM fields GROUP BY term"),
    "lens": (("toks",), "SELECT doc_id, len(body) AS dl FROM toks"),
    "stats": (("lens",), "SELECT CAST(greatest(count(*),1) AS DOUBLE) AS n_docs, CAST(sum(dl) AS DOUBLE)/greatest(count(*),1) AS avgdl FROM lens"),
    "q": ((), f"SELECT unnest({tok(lit(Q3))}) AS term"),
    "qt": (("q",), "SELECT term, CAST(count(*) AS DOUBLE) AS qtf FROM q GROUP BY term"),
    "lists": (("post", "qt"), "SELECT term, list(doc_id ORDER BY doc_id) AS doc_ids, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term"),
    "placed": (("lists",), "SELECT term, row_number() OVER (ORDER BY df, doc_ids, term) AS place FROM lists"),
    "found": (("post", "placed"), "SELECT doc_id, count(*) AS n, min(place) AS place FROM post JOIN placed USING (term) GROUP BY doc_id"),
    "trie": (("found",), "SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, place, doc_id) AS pos FROM found WHERE n >= 2 QUALIFY pos <= 3000"),
    "lex": (("fields", "df2", "lens", "stats", "qt"), "SELECT doc_id, sum(ln((n_docs-df+0.5)/(df+0.5)+1) * (tf_body+2.0*tf_title)*2.2/((tf_body+2.0*tf_title)+1.2*(1-0.75+0.75*dl/greatest(avgdl,1e-9))) * qtf) AS lex FROM fields JOIN qt USING (term) JOIN df2 USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY doc_id"),
    "w": (("post", "df", "nn"), "SELECT p.doc_id, p.term, p.tf/m.top*(ln((n+1)/(df+1))+1) AS w FROM post p JOIN (SELECT doc_id, max(tf) AS top FROM post GROUP BY 1) m USING (doc_id) JOIN df USING (term) CROSS JOIN nn"),
    "qw": (("qt", "df", "nn"), "SELECT term, qtf/(SELECT max(qtf) FROM qt)*(ln((n+1)/(df+1))+1) AS w FROM qt JOIN df USING (term) CROSS JOIN nn"),
    "qc": (("post", "qw"), "SELECT a.term AS q, b.term, count(*) AS n FROM post a JOIN post b USING (doc_id) WHERE a.term IN (SELECT term FROM qw) AND a.term <> b.term GROUP BY 1, 2 HAVING count(*) >= 3"),
    "corr": (("qc", "df", "qw"), "SELECT q, qc.term, n/sqrt(CAST(d1.df AS DOUBLE)*d2.df) AS r FROM qc JOIN df d1 ON d1.term = q JOIN df d2 ON d2.term = qc.term UNION ALL SELECT term, term, 1.0 FROM qw"),
    "x": (("corr", "qw"), "SELECT corr.term, sum(w*r) AS x FROM corr JOIN qw ON qw.term = q GROUP BY corr.term"),
    "sem": (("w", "x", "qw"), "SELECT doc_id, dot/(nd*(SELECT sqrt(sum(w*w)) FROM qw)) AS sem FROM (SELECT doc_id, sum(w*x) AS dot FROM w JOIN x USING (term) GROUP BY 1) JOIN (SELECT doc_id, sqrt(sum(w*w)) AS nd FROM w GROUP BY 1) USING (doc_id) WHERE nd > 0"),
    "rec": (("corpus",), f"SELECT doc_id, {tok("title||chr(10)||text")} AS terms FROM corpus WHERE trim(title) <> '' OR trim(text) <> '' UNION ALL SELECT doc_id, {tok('url')} FROM corpus WHERE NOT (trim(title) <> '' OR trim(text) <> '') AND url <> ''"),
    "raw": (("rec",), f"SELECT doc_id, {HASH_IDX} AS idx, sum({HASH_SIGN}) AS v FROM (SELECT doc_id, unnest(terms) AS term FROM rec) GROUP BY 1, 2 HAVING sum({HASH_SIGN}) <> 0"),
    "emb": (("raw",), "SELECT doc_id, idx, CAST(v AS DOUBLE)/sqrt(CAST(sum(v*v) OVER (PARTITION BY doc_id) AS DOUBLE)) AS v FROM raw"),
    "qraw": (("q",), f"SELECT {HASH_IDX} AS idx, sum({HASH_SIGN}) AS v FROM q GROUP BY 1 HAVING sum({HASH_SIGN}) <> 0"),
    "qemb": (("qraw",), "SELECT idx, CAST(v AS DOUBLE)/sqrt(CAST(sum(v*v) OVER () AS DOUBLE)) AS u FROM qraw"),
    "vec": (("rec", "emb", "qemb"), "SELECT doc_id, vec, row_number() OVER (ORDER BY round(vec,9) DESC, doc_id) AS pos FROM (SELECT rec.doc_id, greatest(0.0, least(1.0, coalesce(d, 0.0))) AS vec FROM rec LEFT JOIN (SELECT doc_id, sum(v*u) AS d FROM emb JOIN qemb USING (idx) GROUP BY 1) USING (doc_id)) QUALIFY pos <= 3000"),
    "cand": (("trie", "vec"), "SELECT doc_id, row_number() OVER (ORDER BY part, p) AS pos FROM (SELECT doc_id, part, p FROM (SELECT doc_id, 0 AS part, pos AS p FROM trie UNION ALL SELECT doc_id, 1, pos FROM vec) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part, p) = 1)"),
    "parts": (("cand", "sem", "lex", "vec"), "SELECT cand.doc_id, cand.pos, coalesce(sem,0.0) AS sem, coalesce(lex,0.0) AS lex, coalesce(vec,0.0) AS vec FROM cand LEFT JOIN sem USING (doc_id) LEFT JOIN lex USING (doc_id) LEFT JOIN vec ON vec.doc_id = cand.doc_id"),
    "fused": (("parts",), "SELECT doc_id, pos, 0.25*(0.6*CASE WHEN max(sem) OVER () > 0 THEN sem/max(sem) OVER () ELSE 0 END + 0.4*CASE WHEN max(lex) OVER () > 0 THEN lex/max(lex) OVER () ELSE 0 END) + 0.75*CASE WHEN (SELECT max(vec) FROM vec) > 0 THEN vec/(SELECT max(vec) FROM vec) ELSE 0 END AS score FROM parts"),
    "ranked": (("fused",), "SELECT doc_id, score, row_number() OVER (ORDER BY round(score,9) DESC, pos) AS rank FROM fused"),
    "ext": ((), f"SELECT page_id, url, {canonical('url')} AS canonical, {domain('url')} AS domain, {strip(chr(32).join(['regexp_extract(html,', lit('(?is)<title[^>]*>(.*?)</title>'), ',1)']))} AS title, {html_text('html')} AS text, {lang_code("regexp_extract(html, '(?is)<html[^>]*\\slang=[\"'']([^\"'']*)[\"'']', 1)")} AS html_language FROM pages"),
    "ext2": (("ext",), f"SELECT *, {relevance('title', 'text', 'canonical')} AS relevance_score, coalesce(html_language, {lang_code(lang_url('url'))}, {lang_text('text')}, 'unknown') AS language, sha256(text) AS text_hash FROM ext"),
    "outcome": (("ext2",), cascade("ext2")),
    "links": ((), f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS pos, link FROM (SELECT page_id, p, {canonical(join_root('url', 'raw'))} AS link FROM (SELECT page_id, url, unnest(l) AS raw, generate_subscripts(l, 1) AS p FROM (SELECT page_id, url, regexp_extract_all(html, {lit(HREF)}, 1) AS l FROM pages)))"),
    "top5": (("ranked", "corpus"), "SELECT doc_id, rank, score, title, text, url FROM ranked JOIN corpus USING (doc_id) WHERE rank <= 5"),
    "sents": (("top5",), f"SELECT doc_id, rank, score AS doc_score, unnest({sentences('text')}) AS sentence, generate_subscripts({sentences('text')}, 1) - 1 AS pos FROM top5"),
    "sscore": (("sents",), f"SELECT doc_id, rank, pos, sentence, len(list_intersect({words(lit(Q3))}, list_distinct({words('sentence')}))) / CAST(greatest(5, len(list_distinct({words('sentence')}))) AS DOUBLE) * (1 + least(1.0, 0.5*doc_score)) AS score FROM sents WHERE len(list_intersect({words(lit(Q3))}, list_distinct({words('sentence')}))) > 0"),
    "best": (("sscore",), "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score,9) DESC, pos) AS n FROM sscore QUALIFY n <= 2"),
    "chosen": (("best",), "SELECT row_number() OVER (ORDER BY rn) AS place, doc_id, sentence, sum(length(sentence)+1) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1 AS used FROM (SELECT *, row_number() OVER (ORDER BY round(score,9) DESC, rank, pos) AS rn FROM best) QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY rn) = 1"),
}


def sql(select: str, *names: str) -> str:
    """``select`` after the named pieces and what they need."""
    out: list[str] = []

    def need(n: str) -> None:
        for d in CTES[n][0]:
            need(d)
        if n not in out:
            out.append(n)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in out) + "\n" + select if out else select
