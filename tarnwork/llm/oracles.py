"""SQL of those queries that SQL can say; they say what the contract says, not how the operators find it.

Hashed statistics (op6, op7, op9), trained scores (op8), compressed media (op4) and tokens (op3) have none; tests hold
them against plain Python.
"""

from __future__ import annotations

from .licenses import BASE, TEMPLATES
from .licenses import LOWER as _LOWER
from .licenses import UPPER as _UPPER


def _licenses(k: int = 3, slack: int = 3, cover: float = 0.8) -> str:
    rows = []
    for t, (label, phrase) in enumerate(TEMPLATES):
        w = phrase.split()
        rows += [f"('{' '.join(w[i : i + k])}',{t},'{label}',{len(w)},{i})" for i in range(len(w) - k + 1)]
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' label, i FROM (SELECT doc_id, w, unnest(range(0, len(w)-{len(p.split()) - 1})) i FROM d) WHERE " + " AND ".join(f"w[i+{j + 1}]='{x}'" for j, x in enumerate(p.split())) for p, label in BASE.items()
    )
    wide = range(2 * slack + 1)
    bits = ", ".join(f"max((x.dg-c.dg={o - slack})::INT) b{o}" for o in wide)
    zeros, steps = ", ".join(f"0 AS a{o}" for o in wide), []
    for o in wide:
        ways = [f"a{o}+coalesce(b{o}, 0)", *([f"a{o + 1}"] if o + 1 in wide else []), *steps[-1:]]
        steps.append(f"greatest({', '.join(ways)})")
    step = ", ".join(steps)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
tpl(gram, t, label, t_len, tp) AS (VALUES {", ".join(rows)}),
b AS ({base}),
bs AS (SELECT doc_id, count(*) n_base, min(i) first_word, max(i) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM b GROUP BY 1),
g AS (SELECT doc_id, i, w[i+1]||' '||w[i+2]||' '||w[i+3] gram FROM (SELECT doc_id, w, unnest(range(0, len(w)-2)) i FROM d)),
-- x: the template's words that stand in common grams, by diagonal. c: alignments with enough of them within the slack.
x AS (SELECT DISTINCT doc_id, t, label, t_len, i-tp dg, tp+o j FROM g JOIN tpl USING (gram), range(0, {k}) r(o)),
dd AS (SELECT DISTINCT doc_id, t, label, t_len, dg FROM x),
c AS (SELECT dd.* FROM dd JOIN x ON x.doc_id=dd.doc_id AND x.t=dd.t AND abs(x.dg-dd.dg)<={slack} GROUP BY ALL HAVING count(DISTINCT x.j)>={cover}*dd.t_len),
bits AS (SELECT c.doc_id, c.t, c.dg, x.j, {bits} FROM c JOIN x ON x.doc_id=c.doc_id AND x.t=c.t AND abs(x.dg-c.dg)<={slack} GROUP BY 1, 2, 3, 4),
-- r: word by word of the template, the longest common run in order up to each offset from the diagonal.
r AS (SELECT doc_id, t, dg, label, t_len, 0 AS j, {zeros} FROM c
  UNION ALL SELECT r.doc_id, r.t, r.dg, r.label, r.t_len, r.j+1, {step} FROM r LEFT JOIN bits q ON q.doc_id=r.doc_id AND q.t=r.t AND q.dg=r.dg AND q.j=r.j WHERE r.j<r.t_len),
ok AS (SELECT doc_id, label, a{2 * slack}/t_len::DOUBLE s FROM r WHERE j=t_len AND a{2 * slack}/t_len::DOUBLE>={cover}),
lb AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) labels FROM (SELECT doc_id, label FROM ok UNION ALL SELECT doc_id, label FROM b) GROUP BY 1),
sc AS (SELECT doc_id, max(s) s FROM ok GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_base, 0)::BIGINT n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
greatest(coalesce(s, 0.0), CASE WHEN n_base>0 THEN 1.0 ELSE 0.0 END)::DOUBLE score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN lb USING (doc_id) LEFT JOIN sc USING (doc_id)"""


_SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, ''))::BIGINT n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2*i+1, 100) s FROM (SELECT doc_id, h, unnest(range(0, greatest(n-49, 0))) i FROM d)),
m AS (SELECT s, min(doc_id) f FROM w GROUP BY 1),
r AS (SELECT doc_id, i, i AS hit FROM w JOIN m USING (s) WHERE f<doc_id),
bt AS (SELECT doc_id, substr(h, 2*i+1, 2) x, i FROM (SELECT doc_id, h, unnest(range(0, n)) i FROM d)),
c AS (SELECT bt.*, coalesce(i-max(hit) OVER (PARTITION BY doc_id ORDER BY i)<50, false) gone FROM bt LEFT JOIN r USING (doc_id, i)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) n_removed, count(*) FILTER (WHERE opens) n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), '') kept FROM e GROUP BY 1)
SELECT doc_id, n n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_CHARS = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1+((('0x'||substr(h, {5 * j + 1}, 5))::BIGINT>>{s})&31))::INT, 1)" for j in range(8) for s in (15, 10, 5, 0))
_ARCHIVES = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT n, sha1(coalesce(html, '')) h FROM pages),
f AS (SELECT h, min(page_id) first FROM p GROUP BY 1)
SELECT page_id, n payload_bytes, {_CHARS} payload_digest, CASE WHEN page_id=first THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id<>first THEN first END refers_to FROM p JOIN f USING (h)"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) END g FROM d),
e AS (SELECT doc_id, len(g) n, unnest(g) x FROM s),
l AS (SELECT a.doc_id p, b.doc_id q FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id AND 100*least(a.n, b.n)>=90*greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*)>=90*(a.n+b.n-count(*))),
y AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
c(p, q) AS (SELECT p, q FROM y UNION SELECT c.p, y.q FROM c JOIN y ON y.p=c.q),
m AS (SELECT p, min(q) q FROM c GROUP BY 1)
SELECT s.doc_id, len(g)::BIGINT n_shingles, least(s.doc_id, coalesce(m.q, s.doc_id)) component_id FROM s LEFT JOIN m ON m.p=s.doc_id"""

#: All frequent itemsets by their baskets' lists; those are closed of which no set of one item more has the same support.
_ITEMSETS = """
WITH RECURSIVE e AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT sale_id) b, greatest(5, (count(DISTINCT sale_id)+19999)//20000) least FROM e),
f AS (SELECT item_id i, list(sale_id) t, count(*) s FROM e GROUP BY 1 HAVING count(*)>=(SELECT least FROM n)),
p AS (SELECT x.item_id i, y.item_id j FROM e x JOIN e y ON x.sale_id=y.sale_id AND x.item_id<y.item_id GROUP BY 1, 2 HAVING count(*)>=(SELECT least FROM n)),
r(items, last, t) AS (SELECT [i], i, t FROM f
  UNION ALL SELECT items, last, t FROM (SELECT list_append(r.items, p.j) items, p.j AS last, list_intersect(r.t, f.t) t FROM r JOIN p ON p.i=r.last JOIN f ON f.i=p.j) WHERE len(t)>=(SELECT least FROM n)),
q AS (SELECT items, len(t)::BIGINT s FROM r),
m AS (SELECT list_filter(items, lambda x: x<>c) items, s FROM (SELECT items, s, unnest(items) c FROM q)),
k AS (SELECT * FROM q ANTI JOIN m ON m.items=q.items AND m.s=q.s),
u AS (SELECT items, s, unnest(items) c FROM k WHERE len(items)>1),
w AS (SELECT u.items, u.c, q.s a, f.s FROM u JOIN q ON q.items=list_filter(u.items, lambda x: x<>u.c) JOIN f ON f.i=u.c, n WHERE 100*u.s>=60*q.s AND u.s*n.b>q.s*f.s),
g AS (SELECT items, count(*) n_rules, arg_min(c, (a, c)) best_item, string_agg(c||':'||a||':'||s, ';' ORDER BY c) told FROM w GROUP BY 1)
SELECT array_to_string(k.items, ',') items, len(k.items)::BIGINT n_items, k.s support, coalesce(n_rules, 0)::BIGINT n_rules, best_item, sha256(coalesce(told, '')) rules_sha256 FROM k LEFT JOIN g USING (items)"""

_INFILL = """
WITH h AS (SELECT doc_id, coalesce(text, '') t, sha256('1:'||doc_id) h FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') w, ('0x'||h[1:8])::BIGINT h1, ('0x'||h[9:16])::BIGINT h2, ('0x'||h[17:24])::BIGINT h3, ('0x'||h[25:32])::BIGINT h4 FROM h),
c AS (SELECT *, len(w)::BIGINT n, least(h1%(len(w)+1), h2%(len(w)+1)) a, greatest(h1%(len(w)+1), h2%(len(w)+1)) b,
  CASE WHEN t='' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3%100>=90 THEN 'plain' WHEN h4%100<20 THEN 'spm' ELSE 'psm' END form FROM d),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') x, array_to_string(w[a+1:b], '') y, array_to_string(w[b+1:], '') z FROM c)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(x) END prefix_chars, CASE WHEN form<>'plain' THEN length(y) END middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>'||x||'<S>'||z||'<M>'||y ELSE '<S>'||z||'<P>'||x||'<M>'||y END) output_sha256, sha256(t) restored_sha256 FROM p"""

_EXACT = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) keep_id, count(*) OVER (PARTITION BY h) group_size, doc_id=max(doc_id) OVER (PARTITION BY h) kept, h text_sha256 FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": _licenses(), "op2_suffix_array_dedup": _SUFFIXES, "op5_zip_archives": _ARCHIVES, "op10_ngram_jaccard_join": _JACCARD, "op11_basket_itemsets": _ITEMSETS, "op12_fill_in_middle": _INFILL, "op13_exact_dedup": _EXACT}
