"""The sanitiser against a plain reader of tags, character by character, and the inline tokens."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from terrafold.functions import html


def values(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, x string").repartition(3).select("k", function(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


@pytest.mark.parametrize("given, left", [
    ('<h1 ID="a" style="b" class=c>x</h1>', '<h1 id="a" class="c">x</h1>'), ("<scripty>a</scripty><SCRIPT>b</SCRIPT >c", "ac"), ("<p a b=1 c='2'>t</p>", "<p>t</p>"), ("<br><b>x</b>", "x"),
    ('<video src="/v" autoplay controls="c" onclick="d">', '<video src="/v" controls="c">'), ("<iframe src=x></iframe>", "Not Allow iframe Not Allow iframe "), ("<script>never closed", "[removed]never closed"), ("</script>a<script/>b</script>c", "ac"),
    ("<a href='#x' title='a \"b\"'>", '<a href="#x" title="a &quot;b&quot;">'), ("<a title=\"&quot;&#39;<>\">", '<a title="&quot;\'&lt;&gt;">'), ("<a href=\"jav\tascript:x\">", "<a href>"), ("<a href=\"java&NewLine;script&colon;x\">", "<a href>"),
    ("<a href='data:image/png;base64,x'><a href='data:text/html,x'>", '<a href="data:image/png;base64,x"><a href>'), ("<!-->x<!--->y<!-- z", "xy"), ("<p", ""), ("a<", "a&lt;"), ("<>", ""), ("< p>x", "x"), ("</ p>x", "x"), ("<p/><img/>", "<p /><img />"),
    ("<a title=\"&#x1F600;&#55357;&#0;z&#zz;\">", '<a title="� z">'), ("﷐<script>x", "�[removed]x"), (None, None), ("", ""), ("<img src=/a/b/>", '<img src="/a/b" />'), ("<a onclick=\"f('x')\" onfocus=g>", "<a onclick=\"f('x')\">"),
])
def test_sanitised(spark, given, left):
    assert values(spark, html.strip_html, [given]) == [left]


class Seen(HTMLParser):
    """What another reader of HTML finds in cleaned text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.bad = []

    def handle_starttag(self, tag, attrs):
        if tag not in html.ELEMENTS:
            self.bad.append(tag)
        for name, value in attrs:
            if name not in html.ELEMENTS.get(tag, ()):
                self.bad.append((tag, name))
            if name in ("href", "src") and value and not value.startswith(html.LINK_STARTS):
                self.bad.append((name, value))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag not in html.ELEMENTS:
            self.bad.append("/" + tag)

    def handle_comment(self, data):
        self.bad.append(("comment", data))

    handle_decl = handle_pi = unknown_decl = handle_comment


def test_nothing_survives_random_pieces(spark):
    some = random.Random(4)
    pieces = ["<", ">", "<a ", "<img ", "<p>", "</p>", "<script>", "</script>", "<!--", "-->", "<iframe ", "<svg/", " onerror=", "onclick='", " href=", " src=", '"', "'", "=", " ", "\n", "/", "javascript:", "&#106;avascript:", "alert(1)", "x", "title", "<video\tposter=", "<style>", "&lt;", "<![CDATA[", "<?x ", "é"]
    texts = ["".join(some.choice(pieces) for _ in range(some.randrange(1, 25))) for _ in range(6000)]
    cleaned = values(spark, html.strip_html, texts)
    for given, left in zip(texts, cleaned):
        seen = Seen()
        seen.feed(left)
        seen.close()
        assert not seen.bad, (given, left, seen.bad)


def test_steps_are_worked_out_once(spark):
    """A value that several rules read stands once in the expression, which so stays small."""
    assert len(str(html.strip_html(F.col("x")))) < 40_000


def test_long_texts_take_no_deep_stack(spark):
    texts = ["<p a=" + "'x' b=" * 50_000 + "1>t", "<" * 60_000, "<a " + "x " * 60_000, "=\"'" * 50_000, "<p>" * 50_000]
    found = values(spark, html.strip_html, texts)
    assert found[0] == "<p>t" and found[1] == "&lt;" * 60_000 and found[4] == texts[4]


def scanned(text):
    """Inline tokens by a plain scanner."""
    out, at = [], 0
    while at < len(text):
        video = re.compile(r"\?\[([^\n\r]*?)\]\(([^\n\r]*?)\)").match(text, at)
        tube = re.compile(r"@\[youtube\]\(([^\n\r]*?)\)").match(text, at)
        if video:
            out.append(f'<video controls src="{video[2]}" poster="{video[2]}?thumb=true" preload="none">{video[1]}</video>')
            at = video.end()
        elif tube and (found := re.fullmatch(r"https://(?:youtu\.be/|youtube\.com/(?:embed/|shorts/))([\w-]{11})(?:[?#].*)?|https://youtube\.com/watch\?v=([\w-]{11})(?:[&#].*)?", tube[1], re.A)):
            out.append(f'<app-youtube video-id="{found[1] or found[2]}" data-src="{tube[1]}"></app-youtube>')
            at = tube.end()
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_tokens_from_left_to_right(spark):
    some = random.Random(6)
    pieces = ["?[", "](", ")", "@[youtube](", "https://youtu.be/", "https://youtube.com/watch?v=", "https://youtube.com/embed/", "abcdefghij_", "abc", "@[youtube](https://youtu.be/abcdefghij_", "@[youtube](https://youtube.com/watch?v=abcdefghij_", "?t=1", "\n", " ", "?", "@", "[", "x"]
    texts = ["".join(some.choice(pieces) for _ in range(some.randrange(1, 14))) for _ in range(3000)]
    assert values(spark, html.media_tokens, texts) == [scanned(t) for t in texts]
    assert any("app-youtube" in scanned(t) for t in texts)
    assert values(spark, html.media_tokens, [None, ""]) == [None, ""]


def test_frames(spark):
    given = "<app-youtube video-id='abcdefghij_' data-src=\"x\"></app-youtube>|<app-youtube data-src=\"x\" video-id=\"abcdefghij_\">|<app-youtube video-id=\"abc\"></app-youtube>|<app-youtube></app-youtube>"
    frame = "abcdefghij_".join(html.FRAME)
    assert values(spark, html.youtube_frames, [given]) == [f'{frame}|{frame}|<app-youtube video-id="abc"></app-youtube>|<app-youtube></app-youtube>']
    assert frame.startswith('<iframe\n') and 'src="https://www.youtube-nocookie.com/embed/abcdefghij_"' in frame
