"""DuckDB oracle SQL for the registered queries.

Independent re-statements of each operator in SQL over the same parquet
tables (views ``pages``, ``documents``, ``supplier`` ...).  Shared pieces
(tokens, extents, region coverage, sites, menus) are CTE texts composed
below; they use RE2-compatible patterns and DuckDB's 1-based lists.
"""
from __future__ import annotations

from sitemill.functions import text as TX
from sitemill.functions import urls as U
from sitemill.operators import html as H
from sitemill.operators import segment as SG
from sitemill.plans import sqlfrag as S
from sitemill.sources import fixtures as FX
from sitemill.sources import legacy as LG
from sitemill.sources import rules as R

VOID = S.inlist(H.VOID_TAGS)
ATTRS = H.ATTRIBUTES


def has_class(cls: str, key: str) -> str:
    return f"coalesce(list_contains(string_split_regex(trim({cls}), '\\s+'), {key}), false)"


def tokens_cte(name: str, src: str, extra: list[str] | None = None) -> str:
    """``name(page_id, <extra>, pos, raw, kind, tag, <attrs>)`` from ``src(page_id, html, <extra>)``."""
    ex = "".join(f", {c}" for c in (extra or []))
    kind = S.kind("raw")
    attrs = ", ".join(f"{S.attribute('_start', a)} AS {q(a)}" for a in ATTRS)
    return f"""
{name}_0 AS (
  SELECT page_id{ex}, CAST(generate_subscripts(_arr, 1) - 1 AS INTEGER) AS pos, unnest(_arr) AS raw
  FROM (SELECT page_id{ex}, regexp_extract_all(html, {S.TOKEN_RX}) AS _arr FROM {src})
),
{name}_1 AS (SELECT *, {S.tag_name('raw')} AS _tag FROM {name}_0),
{name}_2 AS (SELECT *, {kind} AS kind FROM {name}_1),
{name}_3 AS (
  SELECT *, CASE WHEN kind IN ('open', 'close', 'raw') THEN _tag END AS tag,
         CASE WHEN kind = 'raw' THEN string_split(raw, '>')[1] WHEN kind = 'open' THEN raw END AS _start
  FROM {name}_2
),
{name} AS (SELECT page_id{ex}, pos, raw, kind, tag, {attrs} FROM {name}_3)"""


def q(c: str) -> str:
    return '"' + c + '"'


def extents_cte(name: str, tok: str) -> str:
    """Adds ``level``, ``end_pos`` and ``nesting`` (same rules as ``html.with_extents``), the ends that HTML leaves out by joins on the next event."""
    opens = f"(kind = 'open' AND tag NOT IN {VOID})"
    groups = " ".join(f"WHEN {S.q(t)} THEN {S.q('<' + g)}" for t, g in [*H.LISTS.items(), *((t, g) for t, (g, _) in H.ITEMS.items())])
    ranks = " ".join(f"WHEN {S.q(t)} THEN {r}" for t, (_, r) in H.ITEMS.items())
    sides = ", ".join(f"{f}(CASE WHEN rank <= {r} THEN {{'pos': pos, 'tag': tag, 'opens': opens, 'rank': rank}} END IGNORE NULLS) OVER {w} AS {n}{r}"
                      for r in (1, 2, 3) for f, w, n in (("last_value", "before", "p"), ("first_value", "after", "n")))
    own = lambda n: "CASE rank " + " ".join(f"WHEN {r} THEN {n}{r}" for r in (1, 2, 3)) + " END"
    implied = " + ".join(f"CASE WHEN p{r}.opens AND p{r}.rank = {r} AND ((opens AND rank BETWEEN 1 AND {r}) OR (kind = 'close' AND rank < {r})) THEN 1 ELSE 0 END" for r in (1, 2, 3))
    return f"""
{name}_t AS (
  SELECT page_id, pos, kind, tag, {opens} AS opens, CASE tag {groups} ELSE tag END AS grp, CASE tag {ranks} ELSE 0 END AS rank FROM {tok} WHERE kind IN ('open', 'close') AND tag IS NOT NULL
),
{name}_d AS (
  SELECT *, sum(CASE WHEN rank > 0 THEN 0 WHEN opens THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth
  FROM {name}_t
),
{name}_l AS (
  SELECT * EXCLUDE (depth), CASE WHEN opens OR (rank > 0 AND kind = 'close') THEN depth WHEN kind = 'close' THEN depth + 1 END AS lev FROM {name}_d
),
{name}_s AS (
  SELECT *, max(CASE WHEN opens AND rank = 0 THEN pos END) OVER (PARTITION BY page_id, grp, lev ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope
  FROM {name}_l WHERE lev IS NOT NULL
),
{name}_e AS (
  SELECT *, min(CASE WHEN kind = 'close' AND rank = 0 THEN pos END) OVER (PARTITION BY page_id, grp, lev, scope) AS own_end, {sides}
  FROM {name}_s
  WINDOW before AS (PARTITION BY page_id, grp, lev, scope ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY page_id, grp, lev, scope ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
{name}_p AS (
  SELECT page_id, pos, lead(pos) OVER w AS next_pos, lead(tag = 'p' AND kind = 'close') OVER w AS next_closes, coalesce(lag(tag = 'p' AND opens) OVER w, false) AS in_p
  FROM {name}_t WHERE tag IN {S.inlist(['p', *H.BLOCKS])}
  WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
{name}_n AS (
  SELECT e.page_id, e.pos, CASE WHEN e.tag = 'p' THEN 1 ELSE e.lev END AS level,
         CASE WHEN NOT opens THEN NULL WHEN e.tag = 'p' THEN CASE WHEN next_closes THEN next_pos ELSE next_pos - 1 END WHEN rank = 0 THEN own_end
              ELSE CASE WHEN ({own('n')}).tag = e.tag AND NOT ({own('n')}).opens THEN ({own('n')}).pos ELSE ({own('n')}).pos - 1 END END AS own_end,
         CASE WHEN opens THEN 1 WHEN e.tag = 'p' THEN CASE WHEN in_p THEN -1 ELSE 0 END WHEN rank = 0 THEN -1
              WHEN ({own('p')}).tag = e.tag AND ({own('p')}).opens THEN -1 ELSE 0 END - ({implied}) AS nesting
  FROM {name}_e e LEFT JOIN {name}_p p ON p.page_id = e.page_id AND p.pos = e.pos
),
{name} AS (
  SELECT t.*, CAST(n.level AS BIGINT) AS level,
         CAST(CASE WHEN {opens} THEN coalesce(n.own_end, max(t.pos) OVER (PARTITION BY t.page_id)) WHEN kind IN ('open', 'raw') THEN t.pos END AS INTEGER) AS end_pos,
         coalesce(n.nesting, 0) - CASE WHEN coalesce(p.in_p, false) AND NOT (tag = 'p' AND kind = 'close') THEN 1 ELSE 0 END AS nesting
  FROM {tok} t LEFT JOIN {name}_n n ON n.page_id = t.page_id AND n.pos = t.pos LEFT JOIN {name}_p p ON p.page_id = t.page_id AND p.pos = t.pos
)"""


def covered(marker: str) -> str:
    return (f"coalesce(max(CASE WHEN {marker} THEN end_pos END) OVER "
            f"(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= pos, false)")


def start_marker(kind: str, key: str) -> str:
    start = "kind IN ('open', 'raw')"
    if kind == "id":
        return f"({start} AND coalesce(id = {S.q(key)}, false))"
    return f"({start} AND {has_class('class', S.q(key))})"


CONTENT_MARKER = (f"(kind IN ('open', 'raw') AND coalesce((content_kind = 'id' AND id = content_key) OR "
                  f"(content_kind = 'class' AND {has_class('class', 'content_key')}), false))")
REMOVAL_MARKER = ("(kind IN ('open', 'raw') AND coalesce(tag IN " + S.inlist(H.REMOVED_TAGS) + " OR "
                  + " OR ".join(has_class("class", S.q(c)) for c in H.REMOVED_CLASSES) + ", false))")


# ---------------------------------------------------------------------------
# Shared: decorated archive, sites, per-page context
# ---------------------------------------------------------------------------
_prio = " ".join(f"WHEN {start_marker(k, v)} THEN {p}" for f, p, k, v in sorted(R.FAMILY_MARKERS, key=lambda r: r[1]))
_fam_of_prio = " ".join(f"WHEN {p} THEN {S.q(f)}" for f, p, _, _ in R.FAMILY_MARKERS)
_content_kind = " ".join(f"WHEN {S.q(f)} THEN {S.q(k)}" for f, _, k, _ in R.FAMILY_MARKERS)
_content_key = " ".join(f"WHEN {S.q(f)} THEN {S.q(v)}" for f, _, _, v in R.FAMILY_MARKERS)

SITES_CTES = f"""
deco AS ({FX.decorated_sql('pages')}),
reg AS (
  SELECT host AS site, url AS site_url, {S.registered_domain('url')} AS domain,
         'https://' || host || '/' || {S.q(U.MEDIA_PATH)} AS media_base
  FROM deco WHERE r = 1
),
homes AS (SELECT reg.site, min(d.page_id) AS page_id FROM reg JOIN deco d ON d.url = reg.site_url GROUP BY reg.site),
home_src AS (SELECT h.page_id, d.html FROM homes h JOIN deco d ON d.page_id = h.page_id),
{tokens_cte('htok0', 'home_src')},
fam AS (SELECT page_id, min(CASE {_prio} END) AS prio FROM htok0 GROUP BY page_id),
sites AS (
  SELECT reg.site, reg.site_url, reg.domain, coalesce(CASE fam.prio {_fam_of_prio} END, 'X') AS family,
         reg.media_base, homes.page_id AS home_page_id
  FROM reg LEFT JOIN homes ON homes.site = reg.site LEFT JOIN fam ON fam.page_id = homes.page_id
),
sites_x AS (
  SELECT *, CASE family {_content_kind} END AS content_kind, CASE family {_content_key} END AS content_key FROM sites
),
page_ctx AS (
  SELECT d.page_id, d.url, d.html, s.site, s.site_url, s.domain, s.media_base, s.family, s.content_kind, s.content_key
  FROM deco d JOIN sites_x s ON s.site = {S.host('d.url')} WHERE s.family <> 'X'
)"""

# tokens of every known-family page with extents and region flags
PAGE_TOKENS_CTES = f"""{SITES_CTES},
ptok_src AS (SELECT page_id, html, content_kind, content_key FROM page_ctx),
{tokens_cte('ptok0', 'ptok_src', ['content_kind', 'content_key'])},
{extents_cte('ptok1', 'ptok0')},
ptok AS (
  SELECT *, {covered(CONTENT_MARKER)} AS in_content, {covered(REMOVAL_MARKER)} AS removed FROM ptok1
)"""


# ---------------------------------------------------------------------------
# H1 / H2
# ---------------------------------------------------------------------------
TOKEN_RELATION = f"""
WITH {tokens_cte('tok', 'pages')}
SELECT page_id, pos, kind, tag, raw, id, "class", href, src, name, content, rel FROM tok
"""

ELEMENT_EXTENTS = f"""
WITH {tokens_cte('tok', 'pages')},
{extents_cte('ext', 'tok')}
SELECT page_id, tag, pos AS start_pos, end_pos, level FROM ext WHERE kind = 'open' AND tag NOT IN {VOID}
"""

# ---------------------------------------------------------------------------
# U*: URL rules on the decorated archive's links
# ---------------------------------------------------------------------------
URL_RULES = f"""
WITH deco AS ({FX.decorated_sql('pages')}),
src AS (SELECT page_id, html, {S.origin('url')} AS site_url, {S.registered_domain('url')} AS domain FROM deco),
{tokens_cte('tok', 'src', ['site_url', 'domain'])},
l AS (
  SELECT DISTINCT site_url, domain, link FROM (
    SELECT site_url, domain, unnest([href, src]) AS link FROM tok WHERE kind = 'open' AND tag IN ('a', 'img', 'link')
  ) WHERE link IS NOT NULL
)
SELECT site_url, link, {S.scheme('link')} AS scheme, {S.netloc('link')} AS netloc, {S.path('link')} AS path,
       {S.query('link')} AS query, {S.fragment('link')} AS fragment,
       {S.is_relative('link')} AS is_relative, {S.is_internal('link', 'domain')} AS is_internal, {S.is_file('link')} AS is_file,
       {S.file_name('link')} AS file_name, {S.sanitize_filename(S.file_name('link'))} AS sanitized,
       CASE WHEN {S.is_relative('link')} THEN {S.absolute('site_url', 'link')} ELSE link END AS absolute,
       {S.with_scheme('link', 'site_url')} AS with_scheme,
       {S.is_denied('link')} AS denied, (link IS NOT NULL AND contains(link, 'library')) AS library, {S.is_article('link')} AS article,
       regexp_replace(link, '/$', '') AS no_slash, {S.encode_spaces('link')} AS encoded, {S.gallery_source('link')} AS gallery,
       CASE WHEN contains(link, {S.q(R.LOGO_CDN)})
            THEN (CASE WHEN ends_with(site_url, '/') THEN site_url ELSE site_url || '/' END) || {S.q(U.MEDIA_PATH)} || {S.last_seg('link', '/')}
            ELSE link END AS cdn_logo
FROM l
"""

_RULES = ", ".join(f"({S.q(r)})" for r in [*U.PUBLIC_SUFFIXES, *FX.SUFFIX_RULES])
REGISTERED_DOMAIN = f"""
WITH hosts AS (SELECT DISTINCT {S.host('url')} AS host FROM pages),
d AS (
  SELECT DISTINCT input FROM (
    SELECT url AS input FROM pages UNION ALL SELECT source FROM documents UNION ALL SELECT host FROM hosts
    UNION ALL SELECT split_part(host, '.', 1) || '.' || e FROM hosts, (SELECT unnest([{', '.join(S.q(e) for e in FX.OTHER_SUFFIXES)}]) AS e)
  ) WHERE input IS NOT NULL
),
l AS (SELECT input, string_split(lower(regexp_replace({S.last_seg(S.regexp_extract_prefix('input'), '@')}, ':[0-9]*$', '')), '.') AS labels FROM d),
r AS (SELECT DISTINCT string_split(lower(string_split(trim(rule), ' ')[1]), '.') AS rule FROM (VALUES {_RULES}) v(rule) WHERE trim(rule) <> '' AND NOT starts_with(trim(rule), '//')),
fits AS (
  SELECT input, labels, starts_with(rule[1], '!') AS excepted, CASE WHEN starts_with(rule[1], '!') THEN len(rule) - 1 ELSE len(rule) END AS k
  FROM l JOIN r ON len(rule) <= len(labels) AND labels[len(labels) - len(rule) + 2:] = rule[2:]
    AND (rule[1] = '*' OR ltrim(rule[1], '!') = labels[len(labels) - len(rule) + 1])
),
best AS (SELECT input, coalesce(max(k) FILTER (excepted), max(k)) AS k FROM fits GROUP BY input),
f AS (SELECT input, labels, coalesce(k, 0) AS k FROM l LEFT JOIN best USING (input))
SELECT input, coalesce(labels[len(labels) - k], '') || '.' || array_to_string(labels[len(labels) - k + 1:], '.') AS domain FROM f
"""

SLUG_TEXT = f"""
WITH deco AS ({FX.decorated_sql('pages')}),
{tokens_cte('tok', 'deco')},
d AS (
  SELECT DISTINCT input FROM (
    SELECT {S.decode_references('raw')} AS input FROM tok WHERE kind = 'text'
    UNION ALL SELECT {S.path_stem('href')} FROM tok WHERE href IS NOT NULL
  )
),
s AS (SELECT input, {S.slugify('input')} AS slug FROM d)
SELECT input, slug, {S.path_stem('input')} AS stem, regexp_extract_all(slug, '[0-9]+|[^0-9]+') AS runs,
       {S.title_case("replace(slug, '-', ' ')")} AS title
FROM s
"""

TEMPLATE_FAMILY = f"""
WITH {SITES_CTES}
SELECT site, site_url, domain, family, content_kind, content_key, media_base FROM sites_x
"""

SEO_METADATA = f"""
WITH deco AS ({FX.decorated_sql('pages')}),
{tokens_cte('tok', 'deco')},
t AS (
  SELECT *, (lag(kind) OVER w = 'open' AND lag(tag) OVER w = 'title') AS after_title FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
g AS (
  SELECT page_id,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'title') AS mt,
    arg_min({S.decode_references('raw')}, pos) FILTER (WHERE after_title AND kind = 'text') AS tt,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'keywords') AS kw,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'description') AS ds
  FROM t GROUP BY page_id
)
SELECT page_id, coalesce(mt, tt) AS meta_title,
       CASE WHEN length(kw) > 0 THEN left(array_to_string(string_split(kw, ',')[1:{TX.KEYWORD_PHRASES}], ','), {TX.KEYWORD_CHARS}) ELSE kw END AS meta_keywords,
       CASE WHEN length(ds) > 0 THEN left(ds, {TX.DESCRIPTION_CHARS}) ELSE ds END AS meta_description
FROM g
"""

MAIN_CONTENT = f"""
WITH {PAGE_TOKENS_CTES}
SELECT page_id, string_agg(raw, '' ORDER BY pos) AS content FROM ptok WHERE in_content GROUP BY page_id
"""

CLEANED_CONTENT = f"""
WITH {PAGE_TOKENS_CTES}
SELECT page_id, string_agg(raw, '' ORDER BY pos) AS content FROM ptok WHERE in_content AND NOT removed GROUP BY page_id
"""

# ---------------------------------------------------------------------------
# Home-page relations: stylesheets, logos, menus
# ---------------------------------------------------------------------------
HOME_CTES = f"""{SITES_CTES},
hsrc AS (
  SELECT s.home_page_id AS page_id, d.html, s.site, s.site_url, s.domain, s.media_base, s.family
  FROM sites s JOIN deco d ON d.page_id = s.home_page_id WHERE s.family <> 'X'
),
{tokens_cte('htok', 'hsrc', ['site', 'site_url', 'domain', 'media_base', 'family'])},
{extents_cte('hext', 'htok')}"""

_matchers = ", ".join(f"({S.q(f)}, {i}, {S.q(t)})" for f, i, t in R.STYLESHEET_MATCHERS)
STYLESHEETS = f"""
WITH {HOME_CTES},
matchers(family, idx, text) AS (VALUES {_matchers}),
req AS (SELECT family, count(*) AS n FROM matchers GROUP BY family),
m AS (
  SELECT h.page_id, h.site, h.site_url, mt.idx AS matcher, arg_min(h.href, h.pos) AS href
  FROM htok h JOIN matchers mt ON mt.family = h.family AND contains(h.href, mt.text)
  WHERE h.kind = 'open' AND h.tag = 'link' AND h.href IS NOT NULL
  GROUP BY h.page_id, h.site, h.site_url, mt.idx
),
ok AS (
  SELECT m.* FROM m JOIN (SELECT page_id, count(*) AS n FROM m GROUP BY page_id) c ON c.page_id = m.page_id
  JOIN hsrc ON hsrc.page_id = m.page_id JOIN req ON req.family = hsrc.family AND req.n = c.n
),
u AS (SELECT site, matcher, CASE WHEN {S.is_relative('href')} THEN {S.absolute('site_url', 'href')} ELSE href END AS url FROM ok)
SELECT site, CAST(matcher AS INTEGER) AS matcher, url, {S.sanitize_filename(S.file_name('url'))} AS file_name FROM u
"""


def _fam_marker(rows) -> str:
    whens = " ".join(f"WHEN family = {S.q(r[0])} THEN {start_marker(r[1], r[2])}" for r in rows)
    return f"(CASE {whens} ELSE false END)"


_img_root = " ".join(f"WHEN family = {S.q(f)} THEN {str(is_root).lower()}" for f, _, _, is_root in R.LOGO_ROOTS)
_title_rows = [(f, "class", key) for f, p, key in R.LOGO_TEXT if p == "title"]
_desc_rows = [(f, "class", key) for f, p, key in R.LOGO_TEXT if p == "description"]
_nonblank = "(kind = 'text' AND length(regexp_replace(raw, '\\s+', '', 'g')) > 0)"
LOGO_CTES = f"""{HOME_CTES},
t AS (
  SELECT *, {_fam_marker(R.LOGO_ROOTS)} AS is_root, {covered(_fam_marker(R.LOGO_ROOTS))} AS in_root,
         (CASE {_img_root} ELSE false END) AS img_is_root,
         {covered(_fam_marker(_title_rows))} AS in_title, {covered(_fam_marker(_desc_rows))} AS in_desc
  FROM hext
),
g AS (
  SELECT page_id, site, site_url, domain, media_base, family,
    arg_min(src, pos) FILTER (WHERE src IS NOT NULL AND ((img_is_root AND is_root) OR (NOT img_is_root AND in_root AND tag = 'img'))) AS logo_src,
    arg_min({S.decode_references('raw')}, pos) FILTER (WHERE in_title AND {_nonblank}) AS title,
    arg_min({S.decode_references('raw')}, pos) FILTER (WHERE in_desc AND {_nonblank}) AS description
  FROM t GROUP BY page_id, site, site_url, domain, media_base, family
),
g2 AS (
  SELECT *, CASE WHEN family = 'W' THEN
              (CASE WHEN contains(coalesce(logo_src, ''), {S.q(R.LOGO_CDN)})
                    THEN (CASE WHEN ends_with(site_url, '/') THEN site_url ELSE site_url || '/' END) || {S.q(U.MEDIA_PATH)} || {S.last_seg("coalesce(logo_src, '')", '/')}
                    ELSE coalesce(logo_src, '') END)
            ELSE coalesce(logo_src, '') END AS src2
  FROM g
),
g3 AS (SELECT *, ({S.is_internal('src2', 'domain')} AND {S.is_file('src2')}) AS is_f FROM g2),
logos AS (
SELECT site, family, coalesce(title, '') AS title, coalesce(description, '') AS description, src2 AS logo_src,
       CASE WHEN src2 <> '' THEN '/' || coalesce(CASE WHEN is_f THEN {S.sanitize_filename(S.file_name('src2'))} ELSE '' END, '') ELSE '' END AS image_path,
       CASE WHEN is_f THEN {S.with_scheme(f"(CASE WHEN {S.is_relative('src2')} THEN {S.absolute('site_url', 'src2')} ELSE src2 END)", 'site_url')} END AS file_url,
       CASE WHEN is_f THEN {S.sanitize_filename(S.file_name('src2'))} END AS file_name
FROM g3
)"""

LOGOS = f"""
WITH {LOGO_CTES}
SELECT * FROM logos
"""

_root_prio = " ".join(f"WHEN family = {S.q(f)} AND {start_marker(k, v)} THEN {p}" for f, p, k, v, _ in reversed(R.NAV_ROOTS))
_root_list = " ".join(f"WHEN family = {S.q(f)} AND {start_marker(k, v)} THEN {str(il).lower()}" for f, p, k, v, il in reversed(R.NAV_ROOTS))
_excl = " OR ".join(f"(c.family = {S.q(f)} AND {has_class('c.class', S.q(cls))})" for f, cls in R.NAV_EXCLUDED_CLASS.items())
_child = "c.page_id = p.page_id AND c.depth = p.depth + 1 AND c.pos > p.pos AND c.pos <= p.end_pos"
MENU_CTES = f"""{HOME_CTES},
hd AS (
  SELECT *, sum(nesting)
              OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth,
         first_value(CASE WHEN {_nonblank} THEN pos END IGNORE NULLS) OVER wf AS nt_p,
         first_value(CASE WHEN {_nonblank} THEN {S.decode_references('raw')} END IGNORE NULLS) OVER wf AS nt_v,
         first_value(CASE WHEN kind = 'open' AND tag = 'a' AND href IS NOT NULL THEN pos END IGNORE NULLS) OVER wf AS na_p,
         first_value(CASE WHEN kind = 'open' AND tag = 'a' AND href IS NOT NULL THEN href END IGNORE NULLS) OVER wf AS na_v,
         CASE {_root_prio} END AS root_prio, CASE {_root_list} END AS root_is_list
  FROM hext
  WINDOW wf AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
),
st AS (
  SELECT *, min(root_prio) OVER (PARTITION BY page_id) AS best FROM hd
  QUALIFY kind = 'open' AND (tag IN ('ul', 'li') OR root_prio IS NOT NULL)
),
roots AS (SELECT * FROM st WHERE root_prio = best),
lists AS (
  SELECT page_id, pos, end_pos, depth FROM roots WHERE root_is_list AND tag = 'ul'
  UNION ALL
  SELECT c.page_id, c.pos, c.end_pos, c.depth FROM roots p JOIN st c ON {_child} AND c.tag = 'ul' WHERE NOT p.root_is_list
),
items AS (
  SELECT c.page_id, c.site, c.pos, c.end_pos, c.depth, CAST(1 AS BIGINT) AS level, CAST(NULL AS INTEGER) AS parent_pos
  FROM lists p JOIN st c ON {_child} AND c.tag = 'li' WHERE NOT ({_excl or 'false'})
  UNION ALL
  SELECT c.page_id, c.site, c.pos, c.end_pos, c.depth, p.level + 1, p.pos
  FROM items p JOIN st u ON u.page_id = p.page_id AND u.depth = p.depth + 1 AND u.pos > p.pos AND u.pos <= p.end_pos AND u.tag = 'ul'
  JOIN st c ON c.page_id = u.page_id AND c.depth = u.depth + 1 AND c.pos > u.pos AND c.pos <= u.end_pos AND c.tag = 'li'
),
menu AS (
  SELECT i.site, i.page_id, i.pos, i.level, i.parent_pos,
         CASE WHEN s.na_p <= i.end_pos THEN s.na_v END AS url,
         CASE WHEN s.nt_p <= i.end_pos THEN s.nt_v END AS title,
         CASE WHEN s.nt_p <= i.end_pos THEN '/' || {S.slugify('s.nt_v')} END AS url_slug,
         CASE WHEN EXISTS (SELECT 1 FROM st u WHERE u.page_id = i.page_id AND u.depth = i.depth + 1 AND u.pos > i.pos
                           AND u.pos <= i.end_pos AND u.tag = 'ul') THEN 1 ELSE 0 END AS is_parent
  FROM items i JOIN st s ON s.page_id = i.page_id AND s.pos = i.pos
)"""

MENU_ROWS = f"""
WITH RECURSIVE {MENU_CTES}
SELECT site, pos, level, parent_pos, url, title, url_slug, CAST(is_parent AS INTEGER) AS is_parent FROM menu
"""

MENU_PAGES = f"""
WITH RECURSIVE {MENU_CTES},
m AS (
  SELECT m.site, s.site_url, s.domain, s.family,
         CASE WHEN s.family = 'W' THEN {S.http_prefix('s.site_url')} || m.url ELSE m.url END AS u
  FROM menu m JOIN sites s ON s.site = m.site
),
k AS (
  SELECT site, family, CASE WHEN {S.is_relative('u')} THEN {S.absolute('site_url', 'u')} ELSE u END AS page_url
  FROM m WHERE u <> '#' AND {S.is_internal('u', 'domain')} AND NOT {S.is_file('u')}
)
SELECT DISTINCT site, page_url FROM k WHERE NOT (family = 'W' AND {S.is_article('page_url')})
"""

MENU_FILES = f"""
WITH RECURSIVE {MENU_CTES}
SELECT DISTINCT m.site,
       {S.with_scheme(f"(CASE WHEN {S.is_relative('m.url')} THEN {S.absolute('s.site_url', 'm.url')} ELSE m.url END)", 's.site_url')} AS url,
       {S.sanitize_filename(S.file_name('m.url'))} AS file_name
FROM menu m JOIN sites s ON s.site = m.site
WHERE {S.is_internal('m.url', 's.domain')} AND {S.is_file('m.url')}
"""

MAP_CTES = f"""{MENU_CTES},
me0 AS (
  SELECT m.site, s.site_url, s.media_base, m.pos, m.url, m.url_slug, m.title,
         {S.is_relative('m.url')} AS rel, {S.is_file('m.url')} AS isf
  FROM menu m JOIN sites s ON s.site = m.site
  WHERE m.url IS NOT NULL AND m.url <> '#' AND {S.is_internal('m.url', 's.domain')}
),
me1 AS (
  SELECT site, site_url, pos,
         {S.with_scheme("(CASE WHEN rel THEN " + S.absolute('site_url', 'url') + " ELSE url END)", 'site_url')} AS legacy_url,
         CASE WHEN NOT rel AND isf THEN media_base || {S.sanitize_filename(S.file_name('url'))} ELSE url_slug END AS slug,
         CASE WHEN NOT rel AND isf THEN media_base || {S.sanitize_filename(S.file_name('url'))} ELSE title END AS title
  FROM me0
),
entries AS (
  SELECT site, site_url, legacy_url, arg_max(slug, pos) AS slug, arg_max(title, pos) AS title
  FROM me1 GROUP BY site, site_url, legacy_url
),
dec AS (
  SELECT *, '/' || {S.last_seg(S.path('legacy_url'), '/')} AS from_path,
         CASE WHEN {S.is_file('legacy_url')} THEN 'skip'
              WHEN '/' || {S.last_seg(S.path('legacy_url'), '/')} = slug THEN 'skip'
              WHEN legacy_url = site_url THEN 'skip'
              WHEN legacy_url = left(site_url, length(site_url) - 1) THEN 'skip'
              WHEN contains(legacy_url, 'articles/') OR contains(legacy_url, 'articles_dear_doctor') THEN 'skip'
              WHEN contains(legacy_url, 'index') THEN 'home' ELSE 'emit' END AS decision
  FROM entries
),
url_map AS (SELECT site, legacy_url, CASE WHEN decision = 'home' THEN '/' ELSE slug END AS slug, title FROM dec)"""

URL_MAP = f"""
WITH RECURSIVE {MAP_CTES}
SELECT site, legacy_url, slug, title FROM url_map
"""

REDIRECTS = f"""
WITH RECURSIVE {MAP_CTES}
SELECT site, from_path AS from_url, slug AS to_url FROM dec WHERE decision = 'emit'
"""

DISP_CTES = f"""{MAP_CTES},
ptok_src AS (SELECT page_id, html, content_kind, content_key FROM page_ctx),
{tokens_cte('ptok0', 'ptok_src', ['content_kind', 'content_key'])},
{extents_cte('ptok1', 'ptok0')},
ptok AS (SELECT *, {covered(CONTENT_MARKER)} AS in_content FROM ptok1),
lk0 AS (
  SELECT t.page_id, t.pos, p.pass, t.tag, t.href, t.src FROM ptok t, (VALUES (0), (1)) p(pass)
  WHERE t.in_content AND t.kind = 'open' AND t.tag IN ('a', 'img')
    AND NOT {S.is_denied("(CASE WHEN p.pass = 0 THEN t.href ELSE t.src END)")}
),
lk1 AS (
  SELECT l.page_id, l.pos, CAST(l.pass AS INTEGER) AS pass, l.tag, CASE WHEN l.tag = 'a' THEN l.href ELSE l.src END AS link,
         c.site, c.site_url, c.domain, c.media_base
  FROM lk0 l JOIN page_ctx c ON c.page_id = l.page_id
),
lk2 AS (
  SELECT *, CASE WHEN tag = 'a' AND ends_with(link, '/') THEN left(link, length(link) - 1) ELSE link END AS path
  FROM lk1 WHERE link IS NOT NULL
),
lk3 AS (
  SELECT *, {S.is_relative('path')} AS relative,
         CASE WHEN starts_with(link, '#') THEN 'anchor' WHEN {S.is_article('link')} THEN 'article'
              WHEN NOT {S.is_internal('path', 'domain')} THEN 'external' WHEN {S.is_file('path')} THEN 'file' ELSE 'page' END AS stage
  FROM lk2
),
lk4 AS (
  SELECT *, CASE WHEN stage IN ('file', 'page') THEN (CASE WHEN relative THEN {S.absolute('site_url', 'path')} ELSE path END) END AS abs
  FROM lk3
),
lk5 AS (
  SELECT *, CASE WHEN stage = 'file' THEN {S.sanitize_filename(S.file_name('abs'))} END AS file_name,
         CASE WHEN stage = 'page' THEN abs END AS lookup,
         CASE WHEN stage = 'file' THEN {S.with_scheme(f"(CASE WHEN relative THEN {S.encode_spaces('abs')} ELSE {S.gallery_source('path')} END)", 'site_url')} END AS file_url
  FROM lk4
),
disp AS (
  SELECT l.*, m.slug AS map_slug,
         CASE WHEN l.stage IN ('anchor', 'article', 'external') THEN 'leave' WHEN l.stage = 'file' THEN 'file'
              WHEN m.slug IS NOT NULL THEN 'mapped'
              WHEN l.relative OR (contains(l.path, 'https:') AND contains(l.path, 'http:')) THEN 'follow' ELSE 'leave' END AS action
  FROM lk5 l LEFT JOIN url_map m ON m.site = l.site AND m.legacy_url = l.lookup
)"""

LINK_DISPOSITIONS = f"""
WITH RECURSIVE {DISP_CTES}
SELECT page_id, pos, pass, tag, link, stage, action, lookup, file_url, file_name,
       CASE WHEN action = 'file' THEN media_base || file_name WHEN action = 'mapped' THEN {S.last_seg('map_slug', '/')} END AS new_value,
       CASE WHEN action = 'follow' THEN {S.slugify(S.path_stem('lookup'))} END AS stem
FROM disp
"""

NEW_PAGES = f"""
WITH RECURSIVE {DISP_CTES}
SELECT DISTINCT site, lookup AS page_url FROM disp WHERE action = 'follow'
"""


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '#[\\s\\S]*$', ''), '/$', '')"


CRAWL_CLOSURE = f"""
WITH RECURSIVE {DISP_CTES},
keys AS (SELECT page_id, site, {_key('url')} AS key FROM page_ctx),
edges AS (
  SELECT DISTINCT d.page_id AS src, k.page_id AS dst FROM disp d JOIN keys k ON k.site = d.site AND k.key = {_key('d.lookup')}
  WHERE d.action = 'follow'
),
mp0 AS (
  SELECT m.site, s.site_url, s.domain, s.family,
         CASE WHEN s.family = 'W' THEN {S.http_prefix('s.site_url')} || m.url ELSE m.url END AS u
  FROM menu m JOIN sites s ON s.site = m.site
),
mp AS (
  SELECT site, family, CASE WHEN {S.is_relative('u')} THEN {S.absolute('site_url', 'u')} ELSE u END AS page_url
  FROM mp0 WHERE u <> '#' AND {S.is_internal('u', 'domain')} AND NOT {S.is_file('u')}
),
start AS (
  SELECT home_page_id AS page_id FROM sites WHERE family <> 'X'
  UNION
  SELECT k.page_id FROM mp JOIN keys k ON k.site = mp.site AND k.key = {_key('mp.page_url')}
  WHERE NOT (mp.family = 'W' AND {S.is_article('mp.page_url')})
),
reach(page_id, round) AS (
  SELECT page_id, 0 FROM start
  UNION
  SELECT e.dst, r.round + 1 FROM reach r JOIN edges e ON e.src = r.page_id
  WHERE r.round < (SELECT count(*) FROM pages)
)
SELECT page_id, CAST(min(round) AS INTEGER) AS round FROM reach GROUP BY page_id
"""

# ---------------------------------------------------------------------------
# T6 word costs
# ---------------------------------------------------------------------------
WORD_COSTS = f"""
WITH w AS (SELECT unnest(regexp_extract_all({S.fold_letters('text')}, '{SG.WORD_RX}')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS word_rank, count(*) OVER () AS vocab FROM c)
SELECT word, n, CAST(word_rank AS BIGINT) AS word_rank, ln(word_rank * ln(vocab)) AS cost FROM r
"""

# ---------------------------------------------------------------------------
# Legacy business data (same derivation as sources.legacy, in SQL)
# ---------------------------------------------------------------------------
LEGACY_CTES = f"""
sup AS (
  SELECT s.s_suppkey AS k, s.s_name, n.n_nationkey, n.n_name,
         'nation-' || CAST(n.n_nationkey AS VARCHAR) || '-' || CAST(s.s_suppkey // {LG.DOC_BLOCK} AS VARCHAR) AS site,
         CAST(row_number() OVER (PARTITION BY n.n_nationkey, s.s_suppkey // {LG.DOC_BLOCK} ORDER BY s.s_suppkey) - 1 AS INTEGER) AS loc_idx
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
loc AS (
  SELECT site, loc_idx, n_name, k, s_name AS name, 'Street ' || CAST(k AS VARCHAR) AS address1,
         CASE WHEN k % 2 = 0 THEN 'Suite ' || CAST(k % 100 AS VARCHAR) ELSE '' END AS address2,
         n_name AS city, 'ST' AS state, lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS zip, 'US' AS country,
         '555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS phone1, '' AS fax,
         'office' || CAST(k AS VARCHAR) || '@example.test' AS email,
         CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 90 AS VARCHAR) || '.' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS map_lat,
         CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 180 AS VARCHAR) || '.' || lpad(CAST(k % 997 AS VARCHAR), 3, '0') END AS map_long,
         CASE WHEN k % 4 = 0 THEN '' WHEN k % 5 = 0 THEN {S.q(LG.WEEKDAY_HOURS + ',' + LG.SATURDAY_HOURS + ',' + LG.DUPLICATE_MONDAY)}
              ELSE {S.q(LG.WEEKDAY_HOURS)} END AS hours
  FROM sup
)"""

LOCATIONS = f"""
WITH {LEGACY_CTES}
SELECT site AS site_id, to_json({{
  'address': address1, 'address2': address2, 'city': city, 'country': country, 'email': email, 'fax': fax,
  'latitude': CASE WHEN map_lat <> '' THEN TRY_CAST(map_lat AS DOUBLE) END,
  'longitude': CASE WHEN map_long <> '' THEN TRY_CAST(map_long AS DOUBLE) END,
  'name': name, 'phone': phone1, 'state': state,
  'useCoordinates': CASE WHEN length(map_lat) > 0 AND length(map_long) > 0 THEN 'true' ELSE 'false' END,
  'zip': zip}}) AS body
FROM loc
"""

_days = " ".join(f"WHEN {S.q(n)} THEN {S.q(d)}" for n, d in R.DAY_NAMES)
WEEKLY_HOURS = f"""
WITH {LEGACY_CTES},
e AS (
  SELECT site, loc_idx, name AS loc_name, CAST(generate_subscripts(_parts, 1) - 1 AS INTEGER) AS entry_idx, unnest(_parts) AS entry
  FROM (SELECT *, string_split(hours, ',') AS _parts FROM loc WHERE length(hours) > 0)
),
p AS (
  SELECT site, loc_idx, loc_name, entry_idx, string_split(entry, ':') AS x FROM e
),
d AS (
  SELECT site, loc_idx, loc_name, entry_idx, CASE x[1] {_days} END AS day,
         regexp_replace(x[2], '^0+', '') || ':' || x[3] || ' ' || x[4] AS time1_open,
         regexp_replace(x[5], '^0+', '') || ':' || x[6] || ' ' || x[7] AS time1_close
  FROM p
)
SELECT site, loc_idx, loc_name, day, upper(left(day, 1)) || substring(day, 2) AS day_name,
       arg_max(time1_open, entry_idx) AS time1_open, arg_max(time1_close, entry_idx) AS time1_close
FROM d WHERE day IS NOT NULL GROUP BY site, loc_idx, loc_name, day
"""

_social_cases = " ".join(f"WHEN {S.q(t)} THEN {S.q(p)} || value" for t, p, _, _ in R.SOCIAL_MEDIA)
_social_labels = " ".join(f"WHEN {S.q(t)} THEN {S.q(lab)}" for t, _, lab, _ in R.SOCIAL_MEDIA)
_social_icons = " ".join(f"WHEN {S.q(t)} THEN {S.q(ic)}" for t, _, _, ic in R.SOCIAL_MEDIA)
SOCIAL_ACCOUNTS = f"""
WITH {LEGACY_CTES},
docs AS (SELECT DISTINCT site, lower(n_name) AS slug FROM sup),
sm AS (
  SELECT site, CAST(i AS INTEGER) AS sm_idx, token, value FROM docs,
  (VALUES (0, 'facebook_domain', ''), (1, 'twitter_username', '_dental'), (2, 'instagram', ''),
          (3, 'Yelp_url', 'Y'), (4, 'YouTube_url', 'V')) t(i, token, sfx),
  LATERAL (SELECT CASE WHEN sfx = 'Y' THEN 'https://yelp.example.test/' || slug WHEN sfx = 'V' THEN 'https://video.example.test/' || slug
                       ELSE slug || sfx END AS value)
)
SELECT site, sm_idx, CASE token {_social_cases} END AS url, CASE token {_social_labels} END AS label,
       CASE token {_social_icons} END AS iconClass
FROM sm WHERE (CASE token {_social_labels} END) IS NOT NULL
"""

_time = lambda n: f"'time{n}_close', '', 'time{n}_open', ''"
_HOURS_AND_SOCIAL = f"""
SELECT site AS site_id, 'POST' AS method, '/hours/' AS endpoint, '{{"days":{{' || string_agg('"' || day || '":' || json_object('day_name', day_name, 'open', 'true',
         'time1_close', time1_close, 'time1_open', time1_open, {_time(2)}, {_time(3)}), ',' ORDER BY day) || '}},"name":' || to_json(left(loc_name, 40) || ' Hours') || '}}' AS body
FROM ({WEEKLY_HOURS}) GROUP BY site, loc_idx, loc_name
UNION ALL
SELECT site, 'POST', '/socialmedia/', to_json({{'iconClass': iconClass, 'label': label, 'url': url}}) FROM ({SOCIAL_ACCOUNTS})
"""
PAYLOAD_BODIES = f"""
SELECT site AS site_id, 'POST' AS method, '/files/' AS endpoint, to_json({{'filename': file_name, 'url': url}}) AS body FROM ({MENU_FILES})
UNION ALL
SELECT DISTINCT site, 'PUT', '', to_json({{'headerTags': ''}}) FROM ({STYLESHEETS})
UNION ALL
SELECT site, 'POST', '/page_redirects/', to_json({{'fromUrl': from_url, 'matchType': '0', 'toUrl': to_url, 'type': '0'}}) FROM ({REDIRECTS})
UNION ALL
{_HOURS_AND_SOCIAL}"""

_VIS = "{'desktop': 'true', 'mobile': 'true', 'tablet': 'true'}"
_LOGO_ALIASES = ", ".join(f"('{a}')" for c, a in R.COMPONENT_ALIASES if c == "logo")
_LOC_ALIASES = ", ".join(f"('{a}')" for c, a in R.COMPONENT_ALIASES if c == "locations")
_MAP_ALIASES = ", ".join(f"('{a}')" for c, a in R.COMPONENT_ALIASES if c == "maps")
COMPONENT_ROWS = f"""
WITH {LOGO_CTES},
known AS (SELECT site FROM sites WHERE family <> 'X')
SELECT l.site AS site_id, 'PUT' AS method, '/logos/' || a.alias AS endpoint,
       to_json({{'alt_text': 'Logo', 'description': l.description, 'imagePath': l.image_path, 'moduleVisibility': {_VIS},
                 'showDescription': 'true', 'showImage': 'true', 'showTitle': 'true', 'title': l.title}}) AS body
FROM logos l, (VALUES {_LOGO_ALIASES}) a(alias)
UNION ALL
SELECT k.site, 'PUT', '/locations/' || a.alias,
       to_json({{'locations': ['location1'], 'moduleVisibility': {_VIS}, 'showAddress': 'true', 'showAddress2': 'true',
                 'showPhone': 'true', 'showState': 'true', 'showZip': 'true'}})
FROM known k, (VALUES {_LOC_ALIASES}) a(alias)
UNION ALL
SELECT k.site, 'PUT', '/maps/' || a.alias,
       to_json({{'alwaysShowInfoWindow': 'true', 'autoFit': 'true', 'height': '100', 'hue': 'none', 'icon': 'spindle',
                 'iconColor': 'red', 'locations': ['location1'], 'moduleVisibility': {_VIS}, 'showAddressOnHover': 'false',
                 'showCaption': 'true', 'showTitle': 'true', 'width': '100', 'zoom': '14', 'zoomControl': 'true'}})
FROM known k, (VALUES {_MAP_ALIASES}) a(alias)
"""

_NAV_ALIASES = ", ".join(f"('{a}')" for c, a in R.COMPONENT_ALIASES if c == "navigation")
_HOME = S.inlist(["Home", "Welcome"])
MENU_PAYLOAD = f"""
WITH cx AS (
  SELECT n.n_name || '-' || CAST(c.c_custkey // 100 AS VARCHAR) AS site, r.r_name, n.n_name, CAST((c.c_custkey + 1) * 10 AS BIGINT) AS p, c.c_custkey, c.c_name, c.c_mktsegment
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
rows AS (
  SELECT DISTINCT site, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS level, CAST(NULL AS BIGINT) AS parent_pos, '#' AS url, 'Home' AS title FROM cx
  UNION ALL SELECT DISTINCT site, 1, 1, NULL, '/nations/' || lower(n_name) || '.html', n_name FROM cx
  UNION ALL SELECT DISTINCT site, 1152921504606846976, 1, NULL, '/regions/' || lower(r_name), r_name FROM cx
  UNION ALL
  SELECT site, p, 2, 1, CASE WHEN c_custkey % 10 = 0 THEN '/files/' || c_name || '.pdf' ELSE '/customers/' || CAST(c_custkey AS VARCHAR) END,
         CASE WHEN c_custkey % 7 = 0 THEN 'Welcome' ELSE c_name END
  FROM cx
  UNION ALL SELECT site, p + 1, 3, p, 'https://segments.example.test/' || lower(c_mktsegment), c_mktsegment FROM cx
),
t0 AS (
  SELECT *, '/' || {S.slugify('title')} AS url_slug, 'example.test' AS domain,
         'https://' || lower(site) || '.example.test/storage/app/media/' AS media_base,
         row_number() OVER (PARTITION BY site, parent_pos ORDER BY pos) AS rn
  FROM rows
),
t AS (
  SELECT site, pos, level, parent_pos, title,
         CASE WHEN url = '#' THEN '#'
              WHEN {S.is_internal('url', 'domain')} THEN
                (CASE WHEN {S.is_file('url')} THEN media_base || {S.sanitize_filename(S.file_name('url'))}
                      WHEN title IN {_HOME} THEN '/' ELSE url_slug END)
              ELSE url END AS target
  FROM t0 WHERE NOT (title IN {_HOME} AND rn > 1)
),
l3 AS (
  SELECT site, parent_pos, list({{'items': []::VARCHAR[], 'newTab': '0', 'title': title, 'url': target}} ORDER BY pos) AS items
  FROM t WHERE level = 3 GROUP BY site, parent_pos
),
l2 AS (
  SELECT t.site, t.parent_pos,
         list({{'items': coalesce(l3.items, []), 'newTab': '0', 'title': t.title, 'url': t.target}} ORDER BY t.pos) AS items
  FROM t LEFT JOIN l3 ON l3.site = t.site AND l3.parent_pos = t.pos WHERE t.level = 2 GROUP BY t.site, t.parent_pos
),
l1 AS (
  SELECT t.site,
         list({{'items': coalesce(l2.items, []), 'newTab': '0', 'title': t.title, 'url': t.target}} ORDER BY t.pos) AS items
  FROM t LEFT JOIN l2 ON l2.site = t.site AND l2.parent_pos = t.pos WHERE t.level = 1 GROUP BY t.site
)
SELECT site AS site_id, 'PUT' AS method, '/navigations/' || a.alias AS endpoint,
       to_json({{'items': items, 'name': a.alias}}) AS body
FROM l1, (VALUES {_NAV_ALIASES}) a(alias)
"""

STREAM_PAGE_INTAKE = f"""
WITH src AS (SELECT page_id, url, html FROM pages),
{tokens_cte('tok', 'src')},
t AS (
  SELECT *, (lag(kind) OVER w = 'open' AND lag(tag) OVER w = 'title') AS after_title FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
g AS (
  SELECT page_id, count(*) AS n_tokens,
    count(CASE WHEN kind = 'open' AND tag = 'a' AND href IS NOT NULL THEN 1 END) AS n_anchors,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'title') AS mt,
    arg_min({S.decode_references('raw')}, pos) FILTER (WHERE after_title AND kind = 'text') AS tt,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'keywords') AS kw,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'description') AS ds
  FROM t GROUP BY page_id
)
SELECT g.page_id, s.url, n_tokens, n_anchors, coalesce(mt, tt) AS meta_title,
       CASE WHEN length(kw) > 0 THEN left(array_to_string(string_split(kw, ',')[1:{TX.KEYWORD_PHRASES}], ','), {TX.KEYWORD_CHARS}) ELSE kw END AS meta_keywords,
       CASE WHEN length(ds) > 0 THEN left(ds, {TX.DESCRIPTION_CHARS}) ELSE ds END AS meta_description
FROM g JOIN (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) s
  ON s.page_id = g.page_id AND s.rn = 1
"""

# ---------------------------------------------------------------------------
# Segmentation as a recursive dynamic programme over positions
# ---------------------------------------------------------------------------
SEGMENTED_SLUGS = f"""
WITH RECURSIVE
w AS (SELECT unnest(regexp_extract_all({S.fold_letters('text')}, '{SG.WORD_RX}')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
wc AS (SELECT word, ln(row_number() OVER (ORDER BY n DESC, word) * ln(count(*) OVER ())) AS cost FROM c),
maxlen AS (SELECT max(length(word)) AS m FROM wc),
{tokens_cte('tok', 'pages')},
slugs AS (
  SELECT DISTINCT slug FROM (SELECT {S.slugify(S.path_stem('href'))} AS slug FROM tok WHERE href IS NOT NULL)
  WHERE length(slug) > 0 AND NOT contains(slug, '-')
),
sp AS (
  SELECT slug, CAST(generate_subscripts(_p, 1) - 1 AS INTEGER) AS pi, unnest(_p) AS part
  FROM (SELECT slug, regexp_extract_all(slug, '[0-9]+|[^0-9]+') AS _p FROM slugs)
),
parts AS (SELECT DISTINCT part FROM sp WHERE regexp_matches(part, '^[a-z]+$')),
subs AS (
  SELECT p.part, r.i, s.j, substring(p.part, r.i, s.j - r.i + 1) AS sub
  FROM parts p, maxlen, LATERAL range(1, length(p.part) + 1) r(i), LATERAL range(r.i, least(length(p.part), r.i + maxlen.m - 1) + 1) s(j)
),
edges AS (
  SELECT s.part, list({{'s': s.i - 1, 'e': s.j, 'c': coalesce(w.cost, {SG.UNKNOWN_COST})}}) AS edges
  FROM subs s LEFT JOIN wc w ON w.word = s.sub WHERE w.cost IS NOT NULL OR s.i = s.j GROUP BY s.part
),
dp(part, n, edges, i, best) AS (
  SELECT part, length(part), edges, 0, [{{'c': 0.0::DOUBLE, 'k': 0::BIGINT}}] FROM edges
  UNION ALL
  SELECT part, n, edges, i + 1,
         list_append(best, list_min(list_transform(list_filter(edges, lambda x: x.e = i + 1),
                                                   lambda x: {{'c': best[x.s + 1].c + x.c, 'k': (x.e - x.s)::BIGINT}})))
  FROM dp WHERE i < n
),
fin AS (SELECT part, best FROM dp WHERE i = n),
bt(part, best, pos_at, words) AS (
  SELECT part, best, length(part), []::VARCHAR[] FROM fin
  UNION ALL
  SELECT part, best, pos_at - best[pos_at + 1].k, list_prepend(substring(part, pos_at - best[pos_at + 1].k + 1, best[pos_at + 1].k), words)
  FROM bt WHERE pos_at > 0
),
seg AS (SELECT part, words FROM bt WHERE pos_at = 0)
SELECT sp.slug, flatten(list(coalesce(seg.words, [sp.part]) ORDER BY sp.pi)) AS words
FROM sp LEFT JOIN seg ON seg.part = sp.part GROUP BY sp.slug
"""


def segmentation_ctes(slugs: str) -> str:
    """CTEs ``seg_words(slug, words)`` for the hyphen-free slugs of CTE ``slugs(slug)``."""
    return f"""
sw AS (SELECT unnest(regexp_extract_all({S.fold_letters('text')}, '{SG.WORD_RX}')) AS word FROM documents),
sc AS (SELECT word, count(*) AS n FROM sw GROUP BY word),
wc AS (SELECT word, ln(row_number() OVER (ORDER BY n DESC, word) * ln(count(*) OVER ())) AS cost FROM sc),
maxlen AS (SELECT max(length(word)) AS m FROM wc),
sp AS (
  SELECT slug, CAST(generate_subscripts(_p, 1) - 1 AS INTEGER) AS pi, unnest(_p) AS part
  FROM (SELECT slug, regexp_extract_all(slug, '[0-9]+|[^0-9]+') AS _p FROM {slugs})
),
parts AS (SELECT DISTINCT part FROM sp WHERE regexp_matches(part, '^[a-z]+$')),
subs AS (
  SELECT p.part, r.i, s.j, substring(p.part, r.i, s.j - r.i + 1) AS sub
  FROM parts p, maxlen, LATERAL range(1, length(p.part) + 1) r(i), LATERAL range(r.i, least(length(p.part), r.i + maxlen.m - 1) + 1) s(j)
),
sedges AS (
  SELECT s.part, list({{'s': s.i - 1, 'e': s.j, 'c': coalesce(w.cost, {SG.UNKNOWN_COST})}}) AS edges
  FROM subs s LEFT JOIN wc w ON w.word = s.sub WHERE w.cost IS NOT NULL OR s.i = s.j GROUP BY s.part
),
dp(part, n, edges, i, best) AS (
  SELECT part, length(part), edges, 0, [{{'c': 0.0::DOUBLE, 'k': 0::BIGINT}}] FROM sedges
  UNION ALL
  SELECT part, n, edges, i + 1,
         list_append(best, list_min(list_transform(list_filter(edges, lambda x: x.e = i + 1),
                                                   lambda x: {{'c': best[x.s + 1].c + x.c, 'k': (x.e - x.s)::BIGINT}})))
  FROM dp WHERE i < n
),
bt(part, best, pos_at, words) AS (
  SELECT part, best, length(part), []::VARCHAR[] FROM dp WHERE i = n
  UNION ALL
  SELECT part, best, pos_at - best[pos_at + 1].k, list_prepend(substring(part, pos_at - best[pos_at + 1].k + 1, best[pos_at + 1].k), words)
  FROM bt WHERE pos_at > 0
),
seg AS (SELECT part, words FROM bt WHERE pos_at = 0),
seg_words AS (
  SELECT sp.slug, flatten(list(coalesce(seg.words, [sp.part]) ORDER BY sp.pi)) AS words
  FROM sp LEFT JOIN seg ON seg.part = sp.part GROUP BY sp.slug
)"""


_CLOSURE_BODY = CRAWL_CLOSURE.split("WITH RECURSIVE", 1)[1].rsplit("SELECT page_id, CAST(min(round)", 1)[0]
_ru = "regexp_replace(p.url, '/$', '')"
PAGE_IDENTITY = f"""
WITH RECURSIVE {_CLOSURE_BODY.rstrip().rstrip(',')},
processed AS (SELECT page_id FROM reach GROUP BY page_id),
pp AS (
  SELECT c.page_id, c.site, c.site_url, {_ru.replace('p.url', 'c.url')} AS ru
  FROM page_ctx c JOIN processed USING (page_id)
),
pp2 AS (SELECT *, {S.slugify(S.path_stem('ru'))} AS slug0 FROM pp),
idslugs AS (SELECT DISTINCT slug0 AS slug FROM pp2 WHERE length(slug0) > 0 AND NOT contains(slug0, '-')),
{segmentation_ctes('idslugs')},
k AS (
  SELECT p.*, m.slug AS mslug, m.title AS mtitle, coalesce(sw.words, []::VARCHAR[]) AS words,
         CASE WHEN p.ru = p.site_url OR p.ru || '/' = p.site_url OR contains({S.path('p.ru')}, 'index') THEN 'home'
              WHEN m.slug IS NOT NULL THEN 'mapped' ELSE 'derived' END AS kind
  FROM pp2 p LEFT JOIN url_map m ON m.site = p.site AND m.legacy_url = p.ru LEFT JOIN seg_words sw ON sw.slug = p.slug0
),
ident AS (
  SELECT *,
    CASE kind WHEN 'home' THEN '/' WHEN 'mapped' THEN mslug
         ELSE (CASE WHEN contains(slug0, '-') THEN '/' || slug0 ELSE '/' || array_to_string(words, '-') END) END AS url_slug,
    CASE kind WHEN 'home' THEN 'Welcome!' WHEN 'mapped' THEN mtitle
         ELSE (CASE WHEN contains(slug0, '-') THEN {S.title_case("replace(slug0, '-', ' ')")} ELSE {S.title_case("array_to_string(words, ' ')")} END) END AS title,
    CASE kind WHEN 'home' THEN 'home' ELSE 'fullwidth' END AS layout
  FROM k
),
dec2 AS (
  SELECT *, '/' || {S.last_seg(S.path('ru'), '/')} AS from_path,
         CASE WHEN {S.is_file('ru')} THEN 'skip' WHEN '/' || {S.last_seg(S.path('ru'), '/')} = url_slug THEN 'skip'
              WHEN ru = site_url THEN 'skip' WHEN ru = left(site_url, length(site_url) - 1) THEN 'skip'
              WHEN contains(ru, 'articles/') OR contains(ru, 'articles_dear_doctor') THEN 'skip'
              WHEN contains(ru, 'index') THEN 'home' ELSE 'emit' END AS decision
  FROM ident
)
SELECT page_id, site, url_slug, title, layout,
       CASE WHEN kind = 'derived' AND decision = 'emit' THEN from_path END AS from_url,
       CASE WHEN kind = 'derived' AND decision = 'emit' THEN url_slug END AS to_url
FROM dec2
"""

_HREF_RX = S.q(H._attr_rx("href"))
_SRC_RX = S.q(H._attr_rx("src"))
REWRITTEN_CONTENT = f"""
WITH RECURSIVE {_CLOSURE_BODY.rstrip().rstrip(',')},
processed AS (SELECT page_id FROM reach GROUP BY page_id),
dv AS (SELECT *, CASE WHEN action = 'follow' THEN {S.slugify(S.path_stem('lookup'))} END AS stem FROM disp),
lslugs AS (SELECT DISTINCT stem AS slug FROM dv WHERE action = 'follow' AND length(stem) > 0 AND NOT contains(stem, '-')),
{segmentation_ctes('lslugs')},
vals AS (
  SELECT d.page_id, d.pos, d.pass,
         CASE WHEN d.action = 'file' THEN d.media_base || d.file_name
              WHEN d.action = 'mapped' THEN {S.last_seg('d.map_slug', '/')}
              ELSE (CASE WHEN contains(d.stem, '-') THEN d.stem ELSE array_to_string(coalesce(sw.words, []::VARCHAR[]), '-') END) END AS value,
         d.action = 'file' AS is_file
  FROM dv d LEFT JOIN seg_words sw ON sw.slug = d.stem WHERE d.action IN ('file', 'mapped', 'follow')
),
v1 AS (SELECT page_id, pos, arg_min(value, pass) AS value, arg_min(is_file, pass) AS is_file FROM vals GROUP BY page_id, pos),
ptr AS (SELECT *, {covered(REMOVAL_MARKER)} AS removed FROM ptok),
rt AS (
  SELECT t.page_id, t.pos, t.kind, t.tag, t.raw, t.href, v1.value AS new, coalesce(t.tag <> 'a' AND v1.is_file, false) AS to_src, t.removed, t.in_content
  FROM ptr t LEFT JOIN v1 ON v1.page_id = t.page_id AND v1.pos = t.pos
),
rt2 AS (
  SELECT *, CASE WHEN NOT to_src THEN new END AS new_href,
         coalesce(contains(coalesce(CASE WHEN NOT to_src THEN new END, href), 'library'), false) AND kind = 'open' AS lib
  FROM rt WHERE in_content AND NOT removed AND page_id IN (SELECT page_id FROM processed)
),
rt3 AS (
  SELECT *, CASE WHEN lib THEN 'articles' ELSE new_href END AS final_href,
         CASE WHEN to_src THEN regexp_replace(raw, {_SRC_RX}, ' src="' || replace(new, '\\', '\\\\') || '"', 'g') ELSE raw END AS out0
  FROM rt2
),
rt4 AS (
  SELECT *, CASE WHEN final_href IS NULL THEN out0
                 WHEN href IS NOT NULL THEN regexp_replace(out0, {_HREF_RX}, ' href="' || replace(final_href, '\\', '\\\\') || '"', 'g')
                 ELSE regexp_replace(out0, '\\s*/?>$', '') || ' href="' || final_href || '">' END AS out
  FROM rt3
)
SELECT page_id, string_agg(out, '' ORDER BY pos) AS content FROM rt4 GROUP BY page_id
"""


def _between(text: str, start: str, end: str) -> str:
    return text[text.index(start):text.index(end)]


# identity and rewritten-content pieces, re-used with one shared segmentation
_ID_PIECES = _between(PAGE_IDENTITY, "\nprocessed AS (", "\nidslugs AS (")
_ID_TAIL = _between(PAGE_IDENTITY, "\nk AS (", "\nSELECT page_id, site, url_slug, title, layout,")
_RW_PIECES = _between(REWRITTEN_CONTENT, "\ndv AS (", "\nlslugs AS (")
_RW_TAIL = _between(REWRITTEN_CONTENT, "\nvals AS (", "\nSELECT page_id, string_agg(out")
PAGE_PAYLOAD = f"""
WITH RECURSIVE {_CLOSURE_BODY.rstrip().rstrip(',')},
{_ID_PIECES}
idslugs AS (SELECT DISTINCT slug0 AS slug FROM pp2 WHERE length(slug0) > 0 AND NOT contains(slug0, '-')),
{_RW_PIECES}
lslugs AS (SELECT DISTINCT stem AS slug FROM dv WHERE action = 'follow' AND length(stem) > 0 AND NOT contains(stem, '-')),
allslugs AS (SELECT slug FROM idslugs UNION SELECT slug FROM lslugs),
{segmentation_ctes('allslugs')},
{_ID_TAIL.rstrip()},
{_RW_TAIL.rstrip()},
pcontent AS (SELECT page_id, string_agg(out, '' ORDER BY pos) AS content FROM rt4 GROUP BY page_id),
st0 AS (
  SELECT *, (lag(kind) OVER w = 'open' AND lag(tag) OVER w = 'title') AS after_title FROM ptok WINDOW w AS (PARTITION BY page_id ORDER BY pos)
),
sg AS (
  SELECT page_id,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'title') AS mt,
    arg_min({S.decode_references('raw')}, pos) FILTER (WHERE after_title AND kind = 'text') AS tt,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'keywords') AS kw,
    arg_min(content, pos) FILTER (WHERE kind = 'open' AND tag = 'meta' AND content IS NOT NULL AND name = 'description') AS ds
  FROM st0 GROUP BY page_id
),
seo AS (
  SELECT page_id, coalesce(mt, tt) AS meta_title,
         CASE WHEN length(kw) > 0 THEN left(array_to_string(string_split(kw, ',')[1:{TX.KEYWORD_PHRASES}], ','), {TX.KEYWORD_CHARS}) ELSE kw END AS meta_keywords,
         CASE WHEN length(ds) > 0 THEN left(ds, {TX.DESCRIPTION_CHARS}) ELSE ds END AS meta_description
  FROM sg
)
SELECT i.site AS site_id, 'POST' AS method, '/pages/' AS endpoint,
       to_json({{'content': coalesce(c.content, ''), 'layout': i.layout, 'meta_description': s.meta_description,
                 'meta_keywords': s.meta_keywords, 'meta_title': s.meta_title, 'title': i.title, 'url': i.url_slug}}) AS body
FROM ident i LEFT JOIN pcontent c ON c.page_id = i.page_id LEFT JOIN seo s ON s.page_id = i.page_id
"""

_SS_BODY = _between(STYLESHEETS, "\nmatchers(family, idx, text)", "\nSELECT site, CAST(matcher AS INTEGER)")
_LOGO_BODY = LOGO_CTES[len(HOME_CTES):]
FILE_MANIFEST = f"""
WITH RECURSIVE {_CLOSURE_BODY.rstrip().rstrip(',')},
processed AS (SELECT page_id FROM reach GROUP BY page_id)
{_LOGO_BODY},
{_SS_BODY.strip()},
files AS (
  SELECT m.site,
         {S.with_scheme(f"(CASE WHEN {S.is_relative('m.url')} THEN {S.absolute('s.site_url', 'm.url')} ELSE m.url END)", 's.site_url')} AS url,
         {S.sanitize_filename(S.file_name('m.url'))} AS file_name
  FROM menu m JOIN sites s ON s.site = m.site
  WHERE {S.is_internal('m.url', 's.domain')} AND {S.is_file('m.url')}
  UNION ALL
  SELECT u.site, {S.with_scheme('u.url', 'ss.site_url')}, {S.sanitize_filename(S.file_name('u.url'))}
  FROM u JOIN sites ss ON ss.site = u.site
  UNION ALL
  SELECT site, file_url, file_name FROM logos WHERE file_url IS NOT NULL
  UNION ALL
  SELECT site, file_url, file_name FROM disp WHERE action = 'file' AND page_id IN (SELECT page_id FROM processed)
)
SELECT DISTINCT site, url, file_name FROM files
"""


# ---------------------------------------------------------------------------
# The whole request set, in order
# ---------------------------------------------------------------------------
_NAV_BODY = f"""
known AS (SELECT site, domain, media_base FROM sites WHERE family <> 'X'),
n0 AS (SELECT m.*, k.domain, k.media_base, row_number() OVER (PARTITION BY m.site, m.parent_pos ORDER BY m.pos) AS rn FROM menu m JOIN known k ON k.site = m.site),
n1 AS (
  SELECT site, pos, level, parent_pos, title,
         CASE WHEN url = '#' THEN '#'
              WHEN {S.is_internal('url', 'domain')} THEN
                (CASE WHEN {S.is_file('url')} THEN media_base || {S.sanitize_filename(S.file_name('url'))}
                      WHEN coalesce(title IN {_HOME}, false) THEN '/' ELSE url_slug END)
              ELSE url END AS target
  FROM n0 WHERE NOT (coalesce(title IN {_HOME}, false) AND rn > 1)
),
l3 AS (SELECT site, parent_pos, list({{'items': []::VARCHAR[], 'newTab': '0', 'title': title, 'url': target}} ORDER BY pos) AS items FROM n1 WHERE level = 3 GROUP BY site, parent_pos),
l2 AS (
  SELECT t.site, t.parent_pos, list({{'items': coalesce(l3.items, []), 'newTab': '0', 'title': t.title, 'url': t.target}} ORDER BY t.pos) AS items
  FROM n1 t LEFT JOIN l3 ON l3.site = t.site AND l3.parent_pos = t.pos WHERE t.level = 2 GROUP BY t.site, t.parent_pos
),
l1 AS (
  SELECT t.site, list({{'items': coalesce(l2.items, []), 'newTab': '0', 'title': t.title, 'url': t.target}} ORDER BY t.pos) AS items
  FROM n1 t LEFT JOIN l2 ON l2.site = t.site AND l2.parent_pos = t.pos WHERE t.level = 1 GROUP BY t.site
)"""
_PAGE_WITH, _PAGE_SELECT = PAGE_PAYLOAD.split("\nSELECT i.site AS site_id", 1)
_FILES_BODY = _between(FILE_MANIFEST, "\nfiles AS (", "\nSELECT DISTINCT site, url, file_name")
_LOGO_SELECT = _between(COMPONENT_ROWS, "\nSELECT l.site AS site_id", "\nUNION ALL")
# one statement, so that the archive's tokens, menus, links and words are planned once
_OUTBOX = f"""{_PAGE_WITH}
{_LOGO_BODY},
{_SS_BODY.strip()},{_FILES_BODY},{_NAV_BODY},
legacy AS (SELECT site, CAST(home_page_id % 25 AS VARCHAR) AS nation FROM sites WHERE family = 'O'),
requests AS (
  SELECT 1 AS step, known.site AS site_id, 'PUT' AS method, '/navigations/' || a.alias AS endpoint, to_json({{'items': coalesce(l1.items, []), 'name': a.alias}}) AS body
         FROM known LEFT JOIN l1 ON l1.site = known.site, (VALUES {_NAV_ALIASES}) a(alias)
  UNION SELECT 2, site, 'POST', '/files/', to_json({{'filename': file_name, 'url': url}}) FROM files
  UNION SELECT 3, site, 'PUT', '', to_json({{'headerTags': ''}}) FROM ok
  UNION SELECT 4, site, 'POST', '/page_redirects/', to_json({{'fromUrl': from_url, 'matchType': '0', 'toUrl': to_url, 'type': '0'}})
        FROM (SELECT site, from_path AS from_url, slug AS to_url FROM dec WHERE decision = 'emit'
              UNION SELECT site, from_path, url_slug FROM dec2 WHERE kind = 'derived' AND decision = 'emit')
  UNION SELECT 5, * FROM ({_LOGO_SELECT})
  UNION SELECT 6, * FROM (SELECT i.site AS site_id{_PAGE_SELECT})
  UNION SELECT 7, g.site, 'POST', '/locations/', body FROM ({LOCATIONS}) l JOIN legacy g ON g.nation = split_part(l.site_id, '-', 2)
  UNION SELECT CASE endpoint WHEN '/hours/' THEN 8 ELSE 9 END, g.site, method, endpoint, body
        FROM ({_HOURS_AND_SOCIAL}) p JOIN legacy g ON g.nation = split_part(p.site_id, '-', 2)
)"""
OUTBOX_COUNTS = f"""
{_OUTBOX}
SELECT site_id, method, endpoint, count(*) AS n FROM requests GROUP BY site_id, method, endpoint
"""
OUTBOX_SINK = f"""
{_OUTBOX}
SELECT site_id, step, row_number() OVER (PARTITION BY site_id ORDER BY step, sha256(body), method, endpoint) AS seq, method, endpoint, CAST(body AS VARCHAR) AS body FROM requests
"""
