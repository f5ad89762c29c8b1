"""Main texts of all given pages against another parser, the standard library's, with rules of its own."""

from html.parser import HTMLParser

from corpusflow.llm import html_extract
from tests.test_oracles import SF

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "table", "tr", "td", "th", "blockquote", "pre", "section", "article", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "dl", "dt", "dd", "hr"}
ELSEWHERE = {"nav", "aside", "footer", "form", "script", "style", "noscript", "template", "button", "select", "textarea"}
MARKS = ("ad", "comment", "share", "related", "cookie", "promo", "newsletter", "sidebar", "menu", "popup", "banner", "subscribe")


class Article(HTMLParser):
    """Blocks of text inside of article or main, without elements that are elsewhere by name or class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.blocks = [], "", []

    def flush(self):
        if line := " ".join(self.text.split()):
            self.blocks.append(line)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.text += " "
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().replace("-", " ").replace("_", " ").split()
        if tag in BLOCKS | ELSEWHERE | {"main", "span"} and tag not in ("p", "hr"):
            self.open.append((tag, tag in ELSEWHERE or any(w.rstrip("s") in MARKS for w in words)))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(out for _, out in self.open):
            self.text += data


def by_hand(page: str) -> str:
    parser = Article()
    parser.feed(page)
    parser.close()
    parser.flush()
    return "\n".join(parser.blocks)


def test_all_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: by_hand(r["html"] or "") for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark, pages.withColumn("n_chars", pages.page_id)).collect()}
    assert got == want and sum(map(bool, want.values())) > 0.9 * len(want)


def test_where_no_container_is_the_repeated_text_goes(spark):
    """Pages without an article: what two pages of a host share goes, their own text stays; with the step off (a host for each page) all stays."""
    own = [" ".join(f"word{k}x{i}" for i in range(30)) for k in range(6)]
    shared = " ".join(f"shared{i}" for i in range(20))
    page = lambda k: f"<html><body><div>{shared}</div><div>{own[k]}</div></body></html>"
    rows = lambda host: spark.createDataFrame([(k, f"https://{host(k)}/p{k}", page(k)) for k in range(6)], "page_id long, url string, html string")
    texts = lambda host: {r["page_id"]: r["text"] for r in html_extract.extract(spark, rows(host)).collect()}
    assert texts(lambda k: "one.example") == dict(enumerate(own))
    assert texts(lambda k: f"h{k}.example") == {k: f"{shared}\n{own[k]}" for k in range(6)}
