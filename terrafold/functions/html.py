"""Untrusted HTML and the inline tokens that become HTML, by expressions over the tokens of a text.

A text is cut into comments, tags and what is between. In a tag, a quote opens a value only after an equals
sign, and a value then ends at the next such quote; a tag ends at a closing bracket outside values, and a tag
that another opening bracket cuts off is text. Each token is judged by itself, in the JVM, and the texts are
joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.text import ascii_lower, thumb_link  # noqa: F401

#: The elements that may stay, with the attributes that may stay on each, and how a link may start.
ELEMENTS = {
    "h1": ("id", "class"), "h2": ("id", "class"), "h3": ("id",), "h4": ("id",), "h5": ("id",), "h6": ("id",), "pre": ("class",), "a": ("target", "rel", "href", "title", "onclick"),
    "img": ("src", "alt", "onclick"), "video": ("src", "controls", "preload", "poster"), "p": (), "div": ("class",), "span": (), "li": (), "strong": (), "ul": (), "ol": (),
    "blockquote": (), "code": (), "table": (), "tbody": (), "th": (), "td": (), "tr": (), "details": ("class",), "summary": (), "app-youtube": ("video-id", "data-src"),
}
LINK_STARTS = ("http://", "https://", "mailto:", "tel:", "data:image/", "ftp://", "./", "../", "#", "/")
NO_FRAME, REMOVED = "Not Allow iframe ", "[removed]"

#: White space as a browser's scripts know it, for use in classes of characters.
_S = r"\s\x{b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: The inside of a tag, up to a bracket outside values or to a value that no quote ends. No step gives back what it took.
_INSIDE = rf"""(?:[^<>"'=]++|=[{_S}=]*+"[^"]*+"|=[{_S}=]*+'[^']*+'|=(?![{_S}=]*+["'])|["'])*+"""
_TAG = rf"<{_INSIDE}(?:>|(?<=[^<])\z)"
_TOKEN = rf"""(?s){_TAG}|<{_INSIDE}(?==[{_S}=]*+["']).++|<|[^<]++"""
_ATTRIBUTE = rf"""(?s)[^{_S}=]++(?:[{_S}]*+=[{_S}]*+(?:"[^"]*+"|'[^']*+'|[^{_S}]*+))?"""
#: Characters that are in no text stand for script tags until the bodies between them are cut out.
_OPENED, _CLOSED = "﷐", "﷑"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{_S}]++|[{_S}]++$", "")


def _character(entity: Column) -> Column:
    """What a numbered entity stands for; control characters and what is no number are a space, halves of pairs U+FFFD."""
    hexadecimal = F.nullif(F.regexp_extract(entity, "^&#[xX]0*+([0-9a-fA-F]{1,8})", 1), F.lit(""))
    decimal = F.nullif(F.regexp_extract(entity, "^&#0*+([0-9]{1,9})", 1), F.lit(""))
    code = F.coalesce(F.conv(hexadecimal, 16, 10), decimal).cast("long") % 65536
    safe = lambda c: F.when(c.isNull() | (c < 32), 32).when(c.between(0xD800, 0xDFFF), 0xFFFD).otherwise(c)
    return F.decode(F.unhex(F.lpad(F.hex(_let(code, safe)), 4, "0")), "UTF-16BE")


def plain_value(value: Column) -> Column:
    """An attribute's value with its entities resolved, control characters as spaces, trimmed."""
    parts = lambda quoted: F.transform(F.regexp_extract_all(quoted, F.lit("&#[a-zA-Z0-9]*+;?|[^&]++|&"), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit("&#")), _character(p)).otherwise(p))
    resolved = _let(F.regexp_replace(value, "(?i)&quot;", '"'), lambda quoted: F.when(F.contains(quoted, F.lit("&#")), F.array_join(parts(quoted), "")).otherwise(quoted))
    named = F.regexp_replace(F.regexp_replace(resolved, "(?i)&colon;?", ":"), "(?i)&newline;?", " ")
    return _trim(F.regexp_replace(named, r"[\x00-\x1f]", " "))


def safe_value(name: Column, value: Column) -> Column:
    """An attribute's value as it may stay: a link only if it starts as a link may, quotes and brackets as entities."""

    def allowed(plain: Column) -> Column:
        link_ok = F.lit(False)
        for start in LINK_STARTS:
            link_ok = link_ok | F.startswith(plain, F.lit(start))
        return F.when(name.isin("href", "src") & ~link_ok, "").otherwise(plain)

    kept = _let(plain_value(value), allowed)
    for a, b in (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        kept = F.replace(kept, F.lit(a), F.lit(b))
    return kept


def _attribute(text: Column, allowed: Column) -> Column:
    """An attribute as it may stay, or nothing."""
    name = ascii_lower(F.regexp_replace(F.regexp_extract(text, "^[^=]*+", 0), r"[^a-zA-Z0-9\\_:.-]", ""))
    value = _trim(F.regexp_extract(text, "(?s)^[^=]*+=(.*)$", 1))
    bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
    told = lambda name: _let(safe_value(name, _trim(bare)), lambda safe: F.when(safe == "", name).otherwise(F.concat(name, F.lit('="'), safe, F.lit('"'))))
    return _let(name, lambda name: F.when(F.array_contains(allowed, name), told(name)).otherwise(""))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _token(token: Column) -> Column:
    """A token as it may stay."""
    stays = F.create_map(*(x for k, v in ELEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))

    def opened(name: Column, allowed: Column, head: Column, rest: Column) -> Column:
        ends = F.endswith(F.when(rest == "", head).otherwise(rest), F.lit("/"))
        given = F.when(F.endswith(rest, F.lit("/")), _trim(F.substr(rest, F.lit(1), F.length(rest) - 1))).otherwise(rest)
        attributes = F.array_join(F.filter(F.transform(F.regexp_extract_all(given, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: _attribute(a, allowed)), lambda a: a != ""), " ")
        spaced = _let(attributes, lambda a: F.when(a == "", "").otherwise(F.concat(F.lit(" "), a)))
        return F.concat(F.lit("<"), name, spaced, F.when(ends, " /").otherwise(""), F.lit(">"))

    def kept(inside: Column, head: Column, name: Column) -> Column:
        closing = F.startswith(inside, F.lit("/"))
        rest = _trim(F.substr(inside, F.length(head) + 1, F.length(inside)))
        listed = lambda allowed: F.when(allowed.isNull(), "").when(closing, F.concat(F.lit("</"), name, F.lit(">"))).otherwise(_let(rest, lambda rest: opened(name, allowed, head, rest)))
        return F.when(name == "iframe", NO_FRAME).when(name == "script", F.when(closing, _CLOSED).otherwise(_OPENED)).otherwise(_let(F.element_at(stays, name), listed))

    name = lambda head: F.regexp_replace(F.regexp_replace(ascii_lower(head), "^/", ""), "/$", "")
    tag = _let(F.substr(token, F.lit(2), F.length(token) - 2), lambda inside: _let(F.regexp_extract(inside, rf"^[^{_S}]*+", 0), lambda head: _let(name(head), lambda name: kept(inside, head, name))))
    return F.when(token.rlike(rf"(?s)^{_TAG}\z") & (F.length(token) > 1), tag).otherwise(_escaped(token))


def strip_html(x: Column) -> Column:
    """What may stay of untrusted HTML.

    Comments go, an open one with all that follows. Scripts go with their bodies; one that is never closed leaves a
    mark and its body as text. The tags of frames become a notice; those of other elements that are not listed go
    without their bodies. On listed elements the listed attributes stay, in double quotes; a link that does not start
    as a link may leaves its attribute empty. Brackets that are no tag become entities."""
    clean = F.regexp_replace(F.translate(x, _OPENED + _CLOSED, "��"), r"(?s)<!(?=--).*?(?:-->|\z)", "")
    kept = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(_TOKEN), F.lit(0)), _token), "")
    without = F.regexp_replace(F.regexp_replace(kept, f"{_OPENED}[^{_CLOSED}]*+{_CLOSED}", ""), _CLOSED, "")
    return F.replace(without, F.lit(_OPENED), F.lit(REMOVED))


# --- inline tokens ---------------------------------------------------------------------------------

_ID = "([A-Za-z0-9_-]{11})"
_QUERY, _END = r"[^)#\n\r]", r"(?:[?#][^)\n\r]*+)?"
#: Links that name a video, on the hosts known: the id is in one of the groups.
_VIDEO_LINK = rf"[A-Za-z][A-Za-z0-9+.-]*+://(?:[^()/?#@\s]*+@)?(?:(?i:youtu\.be)(?::[0-9]*+)?/{_ID}{_END}|(?i:(?:www\.|m\.)?youtube\.com|www\.youtube-nocookie\.com)(?::[0-9]*+)?/(?:(?:shorts|embed)/{_ID}(?:/[^)?#\n\r]*+)?{_END}|watch\?(?:(?!v=)[^&)#\n\r]*+&)*+v={_ID}(?:&{_QUERY}*+)?(?:#[^)\n\r]*+)?))"
_YOUTUBE = rf"@\[youtube\]\(({_VIDEO_LINK})\)"
_VIDEO = r"\?\[([^\n\r]*?)\]\(([^\n\r]*?)\)"
_INLINE = rf"(?s){_VIDEO}|{_YOUTUBE}|[?@]|[^?@]++"


def media_tokens(x: Column) -> Column:
    """Markdown ?[text](link) as a video element, @[youtube](link) as an embedding, from left to right.

    A token whose link names no video stays text, and reading goes on after its first character."""

    def told(t: Column) -> Column:
        link = F.regexp_extract(t, rf"^{_VIDEO}\z", 2)
        video = F.concat(F.lit('<video controls src="'), link, F.lit('" poster="'), link, F.lit('?thumb=true" preload="none">'), F.regexp_extract(t, rf"^{_VIDEO}\z", 1), F.lit("</video>"))
        found = F.concat(*(F.regexp_extract(t, rf"^{_YOUTUBE}\z", k) for k in (2, 3, 4)))
        frame = F.concat(F.lit('<app-youtube video-id="'), found, F.lit('" data-src="'), F.regexp_extract(t, rf"^{_YOUTUBE}\z", 1), F.lit('"></app-youtube>'))
        return F.when(t.rlike(rf"^{_VIDEO}\z"), video).when(t.rlike(rf"^{_YOUTUBE}\z"), frame).otherwise(t)

    return F.when(x.rlike(r"[?@]\["), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_INLINE), F.lit(0)), told), "")).otherwise(x)


#: The frame that shows a video, from before its id to after it.
FRAME = (
    '<iframe\n                    src="https://www.youtube-nocookie.com/embed/',
    '"\n                    title="YouTube video player"\n                    frameborder="0"\n'
    '                    allow="accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share" referrerpolicy="strict-origin-when-cross-origin"\n'
    '                    allowfullscreen\n                    width="100%" height="315"\n                    style="border:0;"\n                ></iframe>',
)


def youtube_frames(x: Column) -> Column:
    """Embeddings with an id of 11 characters as frames of the host that sets no cookies; others stay."""
    return F.regexp_replace(x, rf"""<app-youtube[{_S}]+[^>]*video-id=["']{_ID}["'][^>]*>(?:</app-youtube>)?""", f"{FRAME[0]}$1{FRAME[1]}")
