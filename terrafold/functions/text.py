"""Text, name, link and style functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def trimmed(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(x, F.lit(WHITE))


def like_pattern(term: str) -> str:
    """The regular expression of a search term: its first character is literal, later % and _ are wildcards, a later
    backslash makes what follows literal and, at the end, asks for a literal % at the end of the text."""
    quoted = lambda c: "\\x{%x}" % ord(c)
    pattern, parts, i = f"%\\{term}%", [""], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            parts[-1] += quoted(pattern[i])
        elif c == "%":
            parts.append("")
        else:
            parts[-1] += "." if c == "_" else quoted(c)
        i += 1
    # Each part at its first place after the part before, which is given up no more, so a text is read once; only the last may have to stand at the end.
    *inner, last = parts[1:]
    return r"(?is)\A" + "".join(f"(?>.*?{p})" for p in inner if p) + (rf".*{last}\z" if last else "")


def matches(x: Column, term: str) -> Column:
    """Search by a term, folding ASCII case alone; an empty term holds everywhere."""
    return x.rlike(like_pattern(term)) if term else F.lit(True)


def blank_to_null(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def name_error(x: Column, most: int = 80) -> Column:
    return F.coalesce(F.char_length(trimmed(x)) > most, F.lit(False))


def password_ok(x: Column) -> Column:
    """At least 8 code points, white space included."""
    return F.coalesce(F.char_length(x) >= 8, F.lit(False))


def share_password_ok(x: Column) -> Column:
    """Blank means none; else 4 to 64 bytes."""
    return F.coalesce(F.octet_length(blank_to_null(x)).between(4, 64), F.lit(True))


def export_name(x: Column, default: str = "export") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(x, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    named = F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit(default)).otherwise(cleaned)
    return F.when(F.endswith(ascii_lower(named), F.lit(".json")), named).otherwise(F.concat(named, F.lit(".json")))


def base_name(x: Column) -> Column:
    """The last path part; null if that holds two dots in a row or a backslash."""
    last = F.element_at(F.split(x, "/"), -1)
    return F.when(~last.contains("..") & ~last.contains("\\"), last)


def extension(x: Column) -> Column:
    """What follows the last dot of the last path part; none if nothing stands before that dot."""
    return F.regexp_extract(x, r"[^/]\.([^./]*)$", 1)


#: The endings that may be uploaded and their content types, exact in case; the kinds a browser may send.
ALLOWED = ("png", "PNG", "jpg", "JPG", "jpeg", "JPEG", "gif", "GIF", "webp", "WEBP", "pdf", "mp4", "MP4")
CONTENT_TYPES = {"jpg": "image/jpeg", "JPG": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "PNG": "image/png", "gif": "image/gif", "GIF": "image/gif", "webp": "image/webp", "WEBP": "image/webp", "mp4": "video/mp4", "MP4": "video/mp4", "pdf": "application/pdf"}
MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "video/mp4", "application/pdf")
DOWNLOADS = ("pdf", "zip", "png", "jpg", "jpeg", "gif", "txt", "csv", "mp4", "mp3")


def upload_allowed(x: Column) -> Column:
    return extension(x).isin(*ALLOWED)


def content_type(x: Column) -> Column:
    kinds = F.create_map(*(F.lit(v) for kv in CONTENT_TYPES.items() for v in kv))
    return F.coalesce(F.element_at(kinds, extension(x)), F.lit("application/octet-stream"))


#: The content types of the files that a page is made of, exact in case.
STATIC_TYPES = {"css": "text/css", "js": "application/javascript", "mjs": "application/javascript", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "html": "text/html"}


def static_type(x: Column) -> Column:
    """By what follows the last dot of the last path part, or by all of it where there is no dot; null where base_name() has none."""
    name = base_name(x)
    kinds = F.create_map(*(F.lit(v) for kv in STATIC_TYPES.items() for v in kv))
    return F.when(name.isNotNull(), F.coalesce(F.element_at(kinds, F.element_at(F.split(name, r"\."), -1)), F.lit("application/octet-stream")))


def mime_allowed(x: Column) -> Column:
    return x.isin(*MIME_TYPES)


def ends_in(x: Column, *endings: str) -> Column:
    """Whether x ends in a dot and one of the endings, whatever their case."""
    return x.rlike(rf"(?i)\.(?:{'|'.join(endings)})\z")


def is_mp4(x: Column) -> Column:
    return ends_in(x, "mp4")


def is_pdf(x: Column) -> Column:
    return ends_in(x, "pdf")


def is_download(href: Column) -> Column:
    return ends_in(href, *DOWNLOADS)


def storage_path(x: Column, thumb: bool = False) -> Column:
    return F.concat_ws("/", F.lit("images"), F.substring(x, 1, 5), *([F.lit("thumb")] if thumb else []), x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def colour(x: Column, fallback: str = "#d94841") -> Column:
    low = ascii_lower(trimmed(x))
    long = F.regexp_replace(low, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    return F.when(long.rlike("^#[0-9a-f]{6}$"), long).otherwise(F.lit(fallback))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1))


#: The hosts whose links name a video.
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com", "youtu.be", "www.youtube-nocookie.com")


def youtube_id(url: Column) -> Column:
    """Of short, watch, shorts and embed links on the hosts known; else null."""
    path = F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    short = F.when(host(url) == "youtu.be", F.regexp_extract(path, r"^/([A-Za-z0-9_-]{11})\z", 1))
    inner = F.regexp_extract(path, r"^/(?:shorts|embed)/([A-Za-z0-9_-]{11})(?:/|\z)", 1)
    first = F.regexp_extract(F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1), "(?:^|&)v=([^&]*)", 1)
    watched = F.when(path == "/watch", F.regexp_extract(first, r"^([A-Za-z0-9_-]{11})\z", 1))
    wide = F.when(host(url).isin(*(h for h in VIDEO_HOSTS if h != "youtu.be")), F.coalesce(watched, inner))
    return F.nullif(F.coalesce(short, wide), F.lit(""))


def is_localhost(url: Column) -> Column:
    return host(url).isin("localhost", "127.0.0.1", "[::1]")


def link_kind(url: Column) -> Column:
    """What a link is shown as: a PDF if it ends in .pdf and is local or relative; other http links are external."""
    external = url.rlike("^https?://")
    return F.when(is_pdf(url) & (~external | is_localhost(url)), "pdf").when(external, "external").otherwise("internal")


#: The titles of links to a PDF, to download one, and to another site.
PDF_TITLE, DOWNLOAD_TITLE, EXTERNAL_TITLE = "PDFリンク", "PDFダウンロードリンク", "外部リンク"


def link_opening(kind: Column, url: Column, installed: Column) -> Column:
    """The start of a link's element: external links and PDFs open a new tab; an installed app downloads PDFs instead."""
    tab = lambda title: F.lit(f'<a target="_blank" rel="noopener noreferrer" title="{title}" ')
    saved = F.concat(F.lit(f'<a href="#" title="{DOWNLOAD_TITLE}" onclick="downloadFile(\''), url, F.lit("')\""))
    return F.when((kind == "pdf") & installed, saved).when(kind == "pdf", tab(PDF_TITLE)).when(kind == "external", tab(EXTERNAL_TITLE)).otherwise("<a ")


def absolute_url(protocol: Column, hostname: Column, port: Column, path: Column) -> Column:
    """protocol with its colon; an empty port is left out with its colon."""
    return F.concat(protocol, F.lit("//"), hostname, F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)), path)


def thumb_link(x: Column) -> Column:
    return F.concat(x, F.when(F.contains(x, F.lit("?")), "&thumb=true").otherwise("?thumb=true"))


def embed_text(filename: Column, link: Column) -> Column:
    return F.when(is_mp4(filename), F.format_string("?[%s](%s)", filename, link)).when(is_pdf(filename), F.format_string("[%s](%s)", filename, link)).otherwise(F.format_string("![%s](%s)", filename, link))


def title_and_body(title: Column, detail: Column) -> Column:
    named = F.when(title == "", F.lit("No Name")).otherwise(title)
    return F.when(detail != "", F.concat(F.lit("# "), named, F.lit("\n\n"), detail)).otherwise(named)


def cookies(x: Column) -> Column:
    """k=v pairs, those with exactly one equals sign, as a map; white space around both goes, the first of a key wins."""
    pairs = F.filter(F.transform(F.split(x, ";"), lambda p: F.transform(F.split(p, "="), trimmed)), lambda p: F.size(p) == 2)
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p[0], p[1])))


def cache_control(x: Column) -> Column:
    """(kind, max_age, header, error) of a setting; what is no kind known, and a bad age, is an error and has no kind."""
    low = F.lower(trimmed(x))
    private = F.startswith(low, F.lit("private"))
    told = F.when(private & low.contains("max-age="), F.regexp_extract(low, "(?s)max-age=(.*)$", 1))
    age = F.when(told.rlike(r"^\+?[0-9]+\z"), told.try_cast("decimal(20,0)"))
    age = F.when(age <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), age)
    bad = told.isNotNull() & age.isNull()
    kind = F.when(low.isin("public", "no-store", "no-cache"), low).when(private & ~bad, "private")
    header = F.when(age.isNotNull(), F.concat(F.lit("private, max-age="), age.cast("string"))).otherwise(kind)
    error = F.when(bad, "Invalid max-age value").when(kind.isNull(), F.concat(F.lit("Unknown cache control: "), x))
    return F.struct(kind.alias("kind"), age.alias("max_age"), header.alias("header"), error.alias("error"))


def with_port(x: Column, port: int = 80) -> Column:
    return F.when(F.contains(x, F.lit(":")), x).otherwise(F.concat(x, F.lit(f":{port}")))


def fixed(x: Column, places: int, even: bool = False) -> Column:
    """The finite number x, below 10 ** (18 - places), with so many places, rounded by its exact value; of two equally near texts the one further from 0, as a browser's, or, as printf's, the even one.

    The product of x and the power of ten is taken as two doubles whose sum is exact."""
    a, power = F.abs(x), float(10**places)
    product = a * power
    split = a * 134217729.0
    high = split - (split - a)
    error = (high * power - product) + (a - high) * power
    whole = F.floor(product)
    over = (product - whole) - 0.5
    tie_up = whole % 2 == 1 if even else F.lit(True)
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & tie_up)))
    scaled = (whole + F.when(up, 1).otherwise(0)).cast("bigint")
    digits = F.lpad(scaled.cast("string"), F.greatest(F.length(scaled.cast("string")), F.lit(places + 1)), F.lit("0"))
    n = F.length(digits)
    text = digits if places == 0 else F.concat(F.substr(digits, F.lit(1), n - places), F.lit("."), F.substr(digits, n - places + 1, F.lit(places)))
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def rounded(x: Column, even: bool = False) -> Column:
    """The nearest whole number as text; of two equally near the larger, or the even one."""
    whole = F.floor(x)
    up = (x - whole > 0.5) | ((x - whole == 0.5) & (whole % 2 != 0)) if even else x - whole >= 0.5
    return (whole + F.when(up, 1).otherwise(0)).cast("bigint").cast("string")


def file_size(x: Column, even: bool = False) -> Column:
    return F.when(x < 1024 * 1024, F.concat(fixed(x / 1024, 1, even), F.lit(" KB"))).otherwise(F.concat(fixed(x / (1024 * 1024), 1, even), F.lit(" MB")))


def percent(loaded: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(loaded * 100 / total + F.lit(0.5)).cast("int")))


def is_mobile(agent: Column) -> Column:
    return F.contains(agent, F.lit("Mobile"))


def listed(value: Column, comma_list: Column) -> Column:
    return F.array_contains(F.transform(F.split(comma_list, ","), lambda v: F.trim(v)), value)


def spliced(x: Column, start: Column, end: Column, piece: Column) -> Column:
    """x with the characters from start up to end, from 0, replaced by piece."""
    return F.concat(F.substr(x, F.lit(1), start), piece, F.substr(x, end + 1, F.greatest(F.length(x) - end, F.lit(0))))
