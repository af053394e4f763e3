"""DuckDB SQL for each query. Written on its own from the rules: RE2 has no lookaround, so neighbours are tested on the gaps between matches."""

from __future__ import annotations

from prosescan.config import Rules
from prosescan.dimensions import BUILTIN_RULES, COMPANIES, DEAD_METAPHORS, ORDINALS, STOP_WORDS, SUMMARIES, spellings
from prosescan.plans.corpora import SEEDED

T = Rules().thresholds

# Written out again, so that a mistake in the engine's own patterns shows.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "\t\n\\x0B\\x0C\r \\x{85}\\x{A0}\\x{1680}\\x{2000}\\x{2001}\\x{2002}\\x{2003}\\x{2004}\\x{2005}\\x{2006}\\x{2007}\\x{2008}\\x{2009}\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WORD = "(?:[a-z]|[A-Z]|[0-9]|')+"
BLANK_LINES = f"\n[{SPACE}]*\n"


def either(literals: list[str]) -> str:
    """The first of the literals that is found at a place, one after the other; case aside for ASCII."""
    escaped = ("".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in x.translate(str.maketrans(UPPER, LOWER))) for x in literals)
    return "(?:" + "|".join(escaped) + ")"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')"


def trim_left(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+', '')"


def lead(x: str) -> str:
    return f"regexp_extract({x}, '^[{SPACE}]*')"


def cut(x: str, a: str, b: str) -> str:
    return f"decode(encode({x})[({a}) + 1:{b}])"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def rule(name: str) -> str:
    return q(BUILTIN_RULES[name][0])


#: A fence opens with up to three bytes of white space; a recursion over the lines that look like fences gives the open blocks.
MASKED = f"""
docs as ({SEEDED.format(string="varchar")}),
raw_lines as (select doc_ord, unnest(l) as line, generate_subscripts(l, 1) - 1 as i from (select doc_ord, string_split(text, chr(10)) as l from docs)),
front as (
  select a.doc_ord, min(b.i) as last from raw_lines a join raw_lines b on a.doc_ord = b.doc_ord and a.i = 0 and b.i > 0
  where {trim("a.line")} = '---' and {trim("b.line")} in ('---', '...') group by a.doc_ord
),
fences as (
  select r.doc_ord, i, run, bare, row_number() over (partition by r.doc_ord order by i) as k
  from (select doc_ord, i, regexp_extract({trim_left("line")}, '^(`{{3,}}|~{{3,}})', 1) as run, {trim(f"regexp_replace({trim_left('line')}, '^(`+|~+)', '')")} = '' as bare
        from raw_lines where strlen({lead("line")}) <= 3) r left join front f using (doc_ord)
  where run <> '' and i > coalesce(f.last, -1)
),
fold as (
  select doc_ord, 0::bigint as k, -1::bigint as opened, '' as run, -1::bigint as was, -1::bigint as i from docs
  union all
  select f.doc_ord, f.k,
         case when p.opened >= 0 then case when p.run[1] = f.run[1] and length(f.run) >= length(p.run) and f.bare then -1 else p.opened end else f.i end,
         case when p.opened >= 0 then p.run else f.run end, p.opened, f.i
  from fold p join fences f on f.doc_ord = p.doc_ord and f.k = p.k + 1
),
hidden as (
  select doc_ord, was as a, i as b from fold where was >= 0 and opened = -1
  union all select doc_ord, opened, 1000000000 from (select *, row_number() over (partition by doc_ord order by k desc) as z from fold) where z = 1 and opened >= 0
  union all select doc_ord, 0, last from front
),
masked as (
  select d.doc_ord, d.name, d.text, m.masked from docs d join (
    select doc_ord, string_agg(case when exists (select 1 from hidden h where h.doc_ord = r.doc_ord and r.i between h.a and h.b) then repeat(' ', strlen(line)::bigint) else line end, chr(10) order by i) as masked
    from raw_lines r group by doc_ord) m using (doc_ord)
)"""


def matches(name: str, of: str, keys: str, text: str, regex: str) -> str:
    """A common table expression: keys, ix, gap, m, next_gap, start, end of the matches."""
    return f"""
{name} as (
  select {keys}, ix, m, gap, after, start + strlen(gap) as start, start + strlen(gap) + strlen(m) as "end"
  from (select *, coalesce(sum(strlen(gap) + strlen(coalesce(m, ''))) over (partition by {keys} order by ix rows between unbounded preceding and 1 preceding), 0)::bigint as start,
               lead(gap) over (partition by {keys} order by ix) as after
        from (select {keys}, unnest(g) as gap, unnest(list_resize(f, len(g))) as m, generate_subscripts(g, 1) as ix
              from (select {keys}, regexp_split_to_array({text}, {q(regex)}) as g, regexp_extract_all({text}, {q(regex)}) as f from {of})))
  where m is not null
)"""


def lines(name: str, of: str, column: str) -> str:
    return f"""
{name} as (
  select doc_ord, line_no, start, start + strlen(line) as "end", line
  from (select doc_ord, line, size, ix - 1 as line_no, coalesce(sum(strlen(line) + 1) over (partition by doc_ord order by ix rows between unbounded preceding and 1 preceding), 0)::bigint as start
        from (select doc_ord, unnest(l) as line, generate_subscripts(l, 1)::bigint as ix, strlen(t) as size from (select doc_ord, {column} as t, string_split({column}, chr(10)) as l from {of})))
  where start < size
)"""


def trimmed(inner: str) -> str:
    """Selects from (doc_ord, .., start, text) with text trimmed."""
    return f"""select * replace (start + strlen({lead("text")}) as start, {trim("text")} as text), start + strlen({lead("text")}) + strlen({trim("text")}) as "end" from ({inner}) where {trim("text")} <> ''"""


ITEM = "^(?:[-*+] |[0-9]+\\. )"
LINES = lines("plain_lines", "masked", "masked") + f""",
lines as (
  select *, not blank and not structure as prose
  from (select *, t = '' as blank, regexp_matches(t, '{ITEM}') as item, t <> '' and (regexp_matches(t, '^[#|>]') or regexp_matches(t, '{ITEM}')) as structure, strlen({lead("line")}) >= 2 as indented
        from (select *, {trim_left("line")} as t from plain_lines))
)"""
PARAGRAPHS = f"""
paragraphs as ({trimmed(f'''
  select doc_ord, text, coalesce(sum(strlen(text) + strlen(coalesce(gap, ''))) over (partition by doc_ord order by ix rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from (select doc_ord, unnest(g) as text, unnest(list_resize(f, len(g))) as gap, generate_subscripts(g, 1) as ix
        from (select doc_ord, regexp_split_to_array(masked, {q(BLANK_LINES)}) as g, regexp_extract_all(masked, {q(BLANK_LINES)}) as f from masked))''')})"""
BLOCKS = f"""
owned as (
  select *, prose and not (indented and coalesce(last_value(decides ignore nulls) over (partition by doc_ord order by line_no rows between unbounded preceding and 1 preceding), 0) = 1) as own
  from (select *, case when structure then 1 when prose and not indented then 0 end as decides from lines)
),
prose_blocks as ({trimmed('''
  select doc_ord, min(start) as start, string_agg(line, chr(10) order by line_no) as text
  from (select *, sum(case when own then 0 else 1 end) over (partition by doc_ord order by line_no) as run from owned) where own group by doc_ord, run''')}),
sentences as (
  select doc_ord, block, row_number() over (partition by doc_ord, block order by start) - 1 as sent_ix, start, "end", text, regexp_extract_all(text, {q(WORD)}) as words
  from ({trimmed(f'''
  select doc_ord, block, text, block + coalesce(sum(strlen(text)) over (partition by doc_ord, block order by ix rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from (select doc_ord, block, unnest(l) as text, generate_subscripts(l, 1) as ix
        from (select doc_ord, start as block, string_split(regexp_replace(text, '([.!?])([{SPACE}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as l from prose_blocks))''')})
)"""


def bold(x: str) -> str:
    return f"(starts_with({x}, '**') and strpos(substr({x}, 3), '**') > 1 or starts_with({x}, '__') and strpos(substr({x}, 3), '__') > 1)"


MARKDOWN = f"""
markdown_blocks as (
  select doc_ord, min(start) as start, max(start + strlen(regexp_replace(line, '[{SPACE}]+\\z', ''))) as "end", bool_or(bold) as opens_bold
  from (select *, sum(case when new then 1 else 0 end) over (partition by doc_ord order by line_no) as block,
               new and case when item then {bold(trim_left(f"regexp_replace(t, '{ITEM}', '')"))} when prose then {bold("t")} else false end as bold
        from (select *, not blank and (structure or not coalesce(lag(item or prose) over (partition by doc_ord order by line_no), false)) as new from lines))
  where not blank group by doc_ord, block
)"""

_PHRASES = [(x.translate(str.maketrans(UPPER, LOWER)), p.id, p.severity) for p in Rules().patterns for x in p.phrases]
PHRASES = matches("phrase_matches", "masked", "doc_ord", low("masked"), either([x for x, _, _ in _PHRASES])) + f""",
phrase_table(phrase, rule_id, severity) as (values {", ".join(f"({q(x)}, {q(r)}, {q(s)})" for x, r, s in _PHRASES)}),
phrase_findings as (
  select doc_ord, rule_id, start, "end", {cut("masked", "start", '"end"')} as matched, null::varchar as expected, 0 as det, 0::bigint as seq
  from phrase_matches p join phrase_table on phrase = m join masked using (doc_ord)
)"""

SPACED = f"""((gap <> '' and regexp_matches(gap, '[{SPACE}]\\z')) or (gap = '' and ix = 1)) and ((after <> '' and regexp_matches(after, '^[{SPACE}]')) or (after = '' and is_last))"""
_RANGES = "regexp_replace(regexp_replace(masked, '([0-9])–([0-9])', '\\1' || repeat(chr(1), 3) || '\\2', 'g'), '([0-9])–([0-9])', '\\1' || repeat(chr(1), 3) || '\\2', 'g')"
EM_DASH = f"""
no_ranges as (select doc_ord, masked, {_RANGES} as t from masked),{matches("dash_matches", "no_ranges", "doc_ord", "t", "—|–|--")},
em_dash as (
  select doc_ord, {rule("em_dash")} as rule_id, start, "end", matched, null::varchar as expected, 1 as det, 0::bigint as seq
  from (select doc_ord, count(*) as n, min(start) as start, max("end") as "end", string_agg(m, ' ' order by ix) as matched
        from (select *, lead(ix) over (partition by doc_ord order by ix) is null as is_last from dash_matches) where m <> '--' or {SPACED} group by doc_ord)
  join (select doc_ord, len(regexp_extract_all(masked, {q(WORD)})) as w from masked) using (doc_ord)
  where n >= {T("em_dash", "floor")} and (n >= {T("em_dash", "count")} or w = 0 or n * 100 // greatest(w, 1) >= {T("em_dash", "rate_per_hundred_words")})
)"""
DECORATION = PARAGRAPHS + "," + ",".join(matches(f"marks_{k}", "(select doc_ord, start as p, text from paragraphs)", "doc_ord, p", "text", f"[{marks}]") for k, marks in enumerate(("“”", "→←↔⇒"))) + """,
decoration as (""" + " union all ".join(f"""
  select doc_ord, {rule("decoration")} as rule_id, p + min(start) as start, p + max("end") as "end", string_agg(m, ' ' order by ix) as matched, null::varchar as expected, 2 as det, {k}::bigint as seq
  from marks_{k} group by doc_ord, p having count(*) >= {T("decoration", "min_occurrences")}""" for k in (0, 1)) + ")"


def finding(name: str, of: str, det: int, seq: int = 0, rule_of: str | None = None) -> str:
    """A table of findings from (doc_ord, start, end), quoting the masked text."""
    return f"""
{name} as (
  select f.doc_ord, {rule(rule_of or name)} as rule_id, f.start, f."end", {cut("masked", "f.start", 'f."end"')} as matched, null::varchar as expected, {det} as det, {seq}::bigint as seq
  from ({of}) f join masked using (doc_ord)
)"""


def ahead(n: int) -> str:
    return f"over (partition by doc_ord, block order by sent_ix rows between current row and {n - 1} following)"


BOLD = MARKDOWN + "," + finding("bold_leads", f"""select doc_ord, min(start) as start, max("end") as "end" from (select *, sum(case when opens_bold then 0 else 1 end) over (partition by doc_ord order by start) as run from markdown_blocks)
  where opens_bold group by doc_ord, run having count(*) >= {T("bold_leads", "min_leads")}""", 3)
_N = T("anaphora", "min_sentences")
ANAPHORA = finding("anaphora", f"""select doc_ord, start, stop as "end" from (select *, count(*) {ahead(_N)} as n, min(key) {ahead(_N)} as a, max(key) {ahead(_N)} as b, max("end") {ahead(_N)} as stop
  from (select *, {low("array_to_string(words[1:2], ' ')")} as key from sentences where len(words) > 0)) where n = {_N} and a = b""", 4)
TRICOLON = f"""
tricolon as (
  select doc_ord, {rule("tricolon")} as rule_id, start, "end", text as matched, null::varchar as expected, 4 as det, 1::bigint as seq
  from (select *, list_filter(list_transform(regexp_split_to_array(text, '[,;]'), lambda c: {low(f"regexp_extract(c, {q(WORD)})")}), lambda w: w <> '') as firsts from sentences)
  where length(text) - length(translate(text, ',;', '')) >= {T("tricolon", "min_separators")}
    and len(list_filter(range(1, len(firsts)), lambda k: firsts[k] = firsts[k + 1])) >= {T("tricolon", "min_repeated_starts")}
)"""
FRAGMENTS = finding("fragments", f"""select doc_ord, min(start) as start, max("end") as "end" from (select *, sum(case when len(words) <= {T("fragments", "max_words")} then 0 else 1 end) over (partition by doc_ord, block order by sent_ix) as run from sentences)
  where len(words) <= {T("fragments", "max_words")} group by doc_ord, block, run having count(*) >= {T("fragments", "min_sentences")}""", 4, 2)
_M = T("analogy", "min_sentences")
ANALOGY = finding("analogy", f"""select doc_ord, start, stop as "end" from (select *, sum(case when regexp_matches({low("text")}, {q("|".join(COMPANIES))}) then 1 else 0 end) {ahead(_M)} as hits, max("end") {ahead(_M)} as stop from sentences) where hits = {_M}""", 4, 3)


def opens(values) -> str:
    return "(" + " or ".join(f"starts_with({low('text')}, {q(v)})" for v in values) + ")"


def fractal(least: int) -> str:
    return finding("fractal", f"""select doc_ord, min(start) as start, max("end") as "end" from paragraphs where {opens(SUMMARIES)} group by doc_ord having count(*) >= {least}""", 6)


def listicle(least: int) -> str:
    return finding("listicle", f"""select doc_ord, start, stop as "end" from (select *, lead("end", {least - 1}) over (partition by doc_ord order by start) as stop from paragraphs where {opens(ORDINALS)}) where stop is not null""", 5)


def metaphor(least: int) -> str:
    return matches("word_matches", "masked", "doc_ord", low("masked"), WORD) + "," + finding("dead_metaphor", f"""select doc_ord, min(start) as start, max("end") as "end" from word_matches where m in ({listed(DEAD_METAPHORS)}) group by doc_ord, m having count(*) >= {least}""", 7)


FRACTAL, LISTICLE, METAPHOR = fractal(T("fractal", "min_openings")), listicle(T("listicle", "min_paragraphs")), metaphor(T("dead_metaphor", "min_repeats"))
TOP = f"""
top_terms as (
  select doc_ord, start, "end", term, n, place
  from (select *, row_number() over (partition by doc_ord, start, "end" order by n desc, term) as place
        from (select doc_ord, start, "end", term, count(*) as n from (select doc_ord, start, "end", unnest(regexp_extract_all({low("text")}, {q(WORD)})) as term from paragraphs)
              where length(term) >= 5 and term not in ({listed(STOP_WORDS)}) group by all))
  where place <= 5
)"""
_S = T("dilution", "min_shared_terms")
DILUTION = TOP + "," + finding("dilution", f"""select doc_ord, start, stop as "end" from (select *, len(list_intersect(list_intersect(terms, lead(terms, 1) over w), lead(terms, 2) over w)) as shared, lead("end", 2) over w as stop
  from (select doc_ord, start, "end", list(term) as terms from top_terms group by all having count(*) >= {_S}) window w as (partition by doc_ord order by start)) where stop is not null and shared >= {_S}""", 8)


def copies(name: str, of: str, det: int) -> str:
    return finding(name, f"""select doc_ord, first as start, "end" from (select *, min(start) over (partition by doc_ord, key) as first from (select doc_ord, start, "end", {low(f"array_to_string(regexp_extract_all(text, {q(WORD)}), ' ')")} as key from {of})
  where length(key) >= {T("duplication", "min_length")}) where start > first""", det, 0, "duplication")


DUP_PARAGRAPHS, DUP_SENTENCES = copies("dup_paragraphs", "paragraphs", 9), copies("dup_sentences", "sentences", 10)


def dialect(wanted: str) -> str:
    pairs = [(b, a) if wanted == "american" else (a, b) for a, b in spellings()]
    return matches("tokens", "masked", "doc_ord", "masked", "[\\p{L}\\p{N}]+") + f""",
spelling(form, other) as (values {", ".join(f"({q(a)}, {q(b)})" for a, b in pairs)}),
dialect as (
  select doc_ord, {rule("dialect")} as rule_id, start, "end", m as matched,
         case when m = upper(m) then upper(other) when m[1] = upper(m[1]) then upper(other[1]) || other[2:] else other end as expected, 11 as det, 0::bigint as seq
  from tokens join spelling on form = {low("m")}
)"""


def regions(name: str, of: str, column: str) -> str:
    mark = lambda x: q(f"prosescan-ignore-{x}")
    rules = lambda x: f"list_filter(regexp_split_to_array(string_split(substr(line, strpos(line, {mark(x)}) + {len('prosescan-ignore-') + len(x)}), '--')[1], '[,{SPACE}]'), lambda y: regexp_matches(y, '[\\p{{L}}\\p{{N}}]'))"
    return lines(f"{name}_lines", of, column) + f""",
{name}_state as (
  select *, kind = 'S' and not was as opens, kind = 'E' and was as closes
  from (select *, coalesce(last_value(case kind when 'S' then 1 when 'E' then 0 end ignore nulls) over (partition by doc_ord order by line_no rows between unbounded preceding and 1 preceding), 0) = 1 as was
        from (select l.*, strlen(d.{column}) as size, least(l."end" + 1, strlen(d.{column})) as stop,
                     case when contains(line, {mark("end")}) then 'E' when contains(line, {mark("start")}) then 'S' when contains(line, {mark("next-line")}) then 'N' else '' end as kind
              from {name}_lines l join {of} d using (doc_ord)))
),
{name} as (
  select doc_ord, min(start) filter (where opens) as start, coalesce(max(stop) filter (where closes), max(size)) as "end", min(start) filter (where opens) as marker_start, any_value({rules("start")}) filter (where opens) as rules
  from (select *, sum(case when opens then 1 else 0 end) over (partition by doc_ord order by line_no) as region from {name}_state) where region > 0 and (opens or closes) group by doc_ord, region
  union all
  select doc_ord, a, b, start, {rules("next-line")}
  from (select *, lead(start) over (partition by doc_ord order by line_no) as a, lead(stop) over (partition by doc_ord order by line_no) as b from {name}_state) where kind = 'N' and a is not null
)"""


def covered(f: str, r: str) -> str:
    return f"{f}.doc_ord = {r}.doc_ord and {f}.start >= {r}.start and {f}.start < {r}.\"end\" and (len({r}.rules) = 0 or len(list_filter({r}.rules, lambda x: {f}.rule_id = x or starts_with({f}.rule_id, x || '.'))) > 0)"


DETECTORS = [PHRASES, EM_DASH, DECORATION, LINES, BOLD, BLOCKS, ANAPHORA, TRICOLON, FRAGMENTS, ANALOGY, LISTICLE, FRACTAL, METAPHOR, DILUTION, DUP_PARAGRAPHS, DUP_SENTENCES]
NAMES = ["phrase_findings", "em_dash", "decoration", "bold_leads", "anaphora", "tricolon", "fragments", "analogy", "listicle", "fractal", "dead_metaphor", "dilution", "dup_paragraphs", "dup_sentences"]
_RULE_ROWS = [(p.id, p.name, p.severity, "phrase") for p in Rules().patterns] + list(BUILTIN_RULES.values())


def everything(names: list[str]) -> str:
    return regions("regions", "masked", "masked") + f""",
rule_table(rule_id, rule_name, severity, kind) as (values {", ".join("(" + listed(r) + ")" for r in _RULE_ROWS)}),
raw_findings as ({" union all ".join(f"select * from {n}" for n in names)}),
all_findings as (
  select doc_ord, rule_id, rule_name, severity, kind, matched, expected, start, "end", min(det) as det, min(seq) as seq
  from raw_findings f join rule_table using (rule_id) where not exists (select 1 from regions r where {covered("f", "r")}) group by all
)"""


ALL = ",".join(DETECTORS) + "," + everything(NAMES)
ALL_AMERICAN = ",".join([*DETECTORS, dialect("american")]) + "," + everything([*NAMES, "dialect"])


def upto(offset: str) -> str:
    return f"decode(encode(text)[1:{offset}])"


def at(before: str) -> tuple[str, str]:
    """Line and column behind this part of the text."""
    return f"length({before}) - length(replace({before}, chr(10), '')) + 1", f"length(regexp_replace(regexp_extract({before}, '[^\\n]*\\z'), '\\r\\z', '')) + 1"


_NW, _NF = T("shared", "min_words"), T("shared", "min_files")
SHARED = matches("cross_plain", "masked", "doc_ord", "masked", WORD) + "," + matches("cross_links", "masked", "doc_ord", "masked", f"https?://[^{SPACE}]*") + f""",
cross_words as (
  select doc_ord, row_number() over (partition by doc_ord order by start) - 1 as w, start, "end", lower(word) as word
  from (select distinct p.doc_ord, coalesce(l.start, p.start) as start, coalesce(l."end", p."end") as "end", coalesce(l.m, p.m) as word
        from cross_plain p left join cross_links l on p.doc_ord = l.doc_ord and p.start >= l.start and p.start < l."end")
),
grams as (
  select * from (select doc_ord, w, string_agg(word, ' ') over n as run, count(*) over n as size, lag(word) over (partition by doc_ord order by w) as before
                 from cross_words window n as (partition by doc_ord order by w rows between current row and {_NW - 1} following)) where size = {_NW}
),
shared_ngrams as (
  select run, count(*) as n, min((doc_ord, w)) as first from grams group by run
  having count(*) > 1 and count(distinct doc_ord) >= {_NF} and (count(before) < count(*) or count(distinct before) > 1)
)"""
#: How far positions agree is found word by word here: the first word that differs from the first position's.
RUNS = SHARED + f""",
positions as (select run, doc_ord, w, first[1] as fd, first[2] as fw from grams join shared_ngrams using (run)),
texts as (select doc_ord, list(word order by w) as words, list(start order by w) as starts, list("end" order by w) as ends from cross_words group by doc_ord),
agreeing as (
  select p.run, p.doc_ord, p.w, t.starts, t.ends,
         coalesce(list_min(list_filter(range({_NW}, greatest(len(t.words) - p.w, len(f.words) - p.fw) + 1), lambda k: t.words[p.w + k + 1] is null or f.words[p.fw + k + 1] is null or t.words[p.w + k + 1] <> f.words[p.fw + k + 1])), {_NW}) as size
  from positions p join texts t using (doc_ord) join texts f on f.doc_ord = p.fd
),
occurrences as (select run, doc_ord, {rule("shared")} as rule_id, starts[w + 1] as start, ends[w + min(size) over (partition by run)] as "end" from agreeing),
kept as (select * from occurrences f where not exists (select 1 from regions r where {covered("f", "r")})),
quoted as (
  select run, first[1] as run_doc, first[2] as run_start, {cut("text", "first[2]", "first[3]")} as matched
  from (select run, min((doc_ord, start, "end")) as first from kept group by run having count(distinct doc_ord) >= {_NF}) join docs on doc_ord = first[1]
)"""


def sql(*tables: str, select: str) -> str:
    return f"with recursive {MASKED}" + "".join("," + t for t in tables) + f"\n{select}"


