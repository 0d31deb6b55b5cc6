import random

from groundmesh.config import Config
from groundmesh.operators.elements import page_elements, page_rows
from groundmesh.operators.sections import assign_sections, image_chunks, section_tree, svg_assets, text_chunks, visuals

PAGE = """<html><head><title>Course</title></head><body><p>before</p><h1>A</h1><p>one <b>two</b><p>three
<h2>B</h2><ul><li>x<ul><li>y</li></ul></li></ul><table><tr><th>a</th><td>b</td></tr><tr><td><p>c</p></td><td> </td></tr></table>
<figure><svg viewBox="0 0 1 1"><text>L1</text><text>L1</text><text>L2</text></svg></figure><figcaption>Cap</figcaption>
<img src=x><h4>Deep</h4><p>z</p><h2>B</h2><button>no</button><h2>B</h2><p>more</p><h1 class="q"></h1>
<div class="card-h1">Card</div><div class="card-p">text</div><script>x = {html:`<h2>Made</h2><p>inside</p><button>b</button>`}</script></body></html>"""


def tree_of(spark, html, name="mod.html"):
    assigned = assign_sections(page_elements(spark.createDataFrame([(name, html)], "source_file string, html string")))
    return assigned, section_tree(assigned)


def test_sections_and_chunks(spark):
    assigned, tree = tree_of(spark, PAGE)
    rows = tree.orderBy("pos").collect()
    assert [(r.level, r.title, r.section_id, r.parent_title) for r in rows] == [
        (0, "Course", "course", None), (1, "A", "mod-a", "Course"), (2, "B", "mod-b", "A"), (4, "Deep", "mod-deep", "B"), (2, "B", "mod-b-2", "A"), (2, "B", "mod-b-3", "A"),
        (1, "Card", "mod-card", "Course"), (2, "Made", "mod-made", "Card"),
    ]
    assert rows[0].content == "before" and rows[0].child_titles == ["A", "Card"]
    assert rows[1].content == "one two three" and rows[2].breadcrumb == ["Course", "A", "B"]
    assert rows[2].content == "x y y a | b ; c L1 L1 L2 Cap"
    assert rows[7].content == "inside"
    chunks = text_chunks(tree, Config()).collect()
    assert {c.title for c in chunks} == {"A", "B", "Deep", "Card", "Made"} and all(c.content.startswith(c.title) for c in chunks)
    images = {r.type: r for r in image_chunks(visuals(assigned, tree)).collect()}
    assert images["svg"].description == "Diagram under: B. Caption: Cap. Visible labels: L1; L2. Context: A / mod.html."
    assert images["img"].description == 'Diagram attached to section "B" in "mod.html".'
    assert images["svg"].metadata.order_in_file == 1 and images["svg"].metadata.view_box == "0 0 1 1"
    assert svg_assets(visuals(assigned, tree)).first().svg.startswith("<svg viewBox")


def test_windows_equal_a_stack(spark):
    rng = random.Random(3)
    pages, expected = [], {}
    for n in range(25):
        levels = [rng.randint(1, 4) for _ in range(12)]
        pages.append((f"p{n}.html", "<title>T</title>" + "".join(f"<h{x}>t{i}</h{x}>" for i, x in enumerate(levels))))
        stack = [(0, "T")]
        for i, x in enumerate(levels):
            while stack[-1][0] >= x:
                stack.pop()
            stack.append((x, f"t{i}"))
            expected[f"p{n}.html", f"t{i}"] = [s for _, s in stack]
    tree = section_tree(assign_sections(page_elements(spark.createDataFrame(pages, "source_file string, html string"))))
    assert {(r.source_file, r.title): r.breadcrumb for r in tree.where("level > 0").collect()} == expected


def test_deep_and_wide_pages():
    deep = page_rows("d", "<div>" * 100_000 + "<p>low</p>" + "<ul><li>" * 300 + "x")
    assert [r["text"] for r in deep[1:3]] == ["low", "x"] and len(deep) == 302
    assert page_rows("d", "<p>a" + "<table><tr><td>" + "<div>" * 100_000 + "</table><p>b")[-1]["text"] == "b"
    wide = page_rows("w", "<h1>T</h1>" + '<img src="a">' * 50_000 + "<figcaption>last</figcaption>")
    assert wide[-2]["caption"] == "last" and wide[2]["caption"] == "" and len(wide) == 50_003
    rows = page_rows("t", "<table><tr><td>a<td>b<tr><td>c</table>")
    assert rows[1]["text"] == "a | b ; c"


CUT = "a&amp;b &lt &ampx; &copy;&unknown; &#65 \ue000&amp"


def test_images_of_pages_with_cut_references(spark):
    """a title that ends in the middle of ``&amp;`` keeps what it has; places in the markup do not move."""
    assigned, tree = tree_of(spark, f'<title>{CUT}</title><h1>{CUT}</h1><p>&notit</p><svg class="x&amp"><text>&amp</text></svg>')
    said = "a&b &lt &ampx; \xa9&unknown; A \ue000&amp"
    image = image_chunks(visuals(assigned, tree)).first()
    assert image.title == said and image.description == f"Diagram under: {said}. Visible labels: &amp. Context: {said} / mod.html."
    assert image.metadata.raw_svg_excerpt == '<svg class="x&amp"><text>&amp</text></svg>'


def test_parents_of_made_sections_with_cut_references(spark):
    """a table and a template string behind such a title have it as their parent."""
    rows = tree_of(spark, "<h1>Go &amp</h1><h2>Parts</h2><table><tr><td>a &quot<td>b</table><script>x = {html:`<h2>Made</h2><p>&amp`}</script>")[1].where("level = 2").orderBy("pos").collect()
    assert [(r.title, r.parent_title, r.content) for r in rows] == [("Parts", "Go &amp", "a &quot | b"), ("Made", "Go &amp", "&amp")]


def test_sections_of_pages_with_cut_references(spark):
    """titles, ids and breadcrumbs of the section tree."""
    rows = tree_of(spark, "<title>Go &amp</title><h1>Go &amp</h1><p>a &lt b &amp; c</p>")[1].orderBy("pos").collect()
    assert [(r.title, r.section_id, r.content) for r in rows] == [("Go &amp", "go-amp", ""), ("Go &amp", "mod-go-amp", "a &lt b & c")] and rows[1].breadcrumb == ["Go &amp", "Go &amp"]


def test_chunks_of_pages_with_cut_references(spark):
    """content, concept and length of a chunk."""
    chunk = text_chunks(tree_of(spark, "<h1>Go &amp</h1><p>text &am")[1], Config()).first()
    assert (chunk.content, chunk.concept_id, chunk.metadata.content_length) == ("Go &amp text &am", "go-amp", 16)


def test_empty_and_null_pages(spark):
    _, tree = tree_of(spark, None)
    assert tree.count() == 1
    none = spark.createDataFrame([], "source_file string, html string")
    assert section_tree(assign_sections(page_elements(none))).count() == 0


def test_stream_of_pages(spark, tmp_path):
    """Three runs: a page comes, comes again changed with a new one, and comes late in an older version."""
    from groundmesh.sources.snapshots import StoredTable
    from groundmesh.streaming.incremental import chunk_stream, merge_pages, stored_chunks

    shape, folder = "source_file string, html string, version long", str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pages = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        chunk_stream(pages, folder, str(tmp_path / "state"), Config()).awaitTermination(120)
        return sorted((c.source_file, c.title, c.content) for c in stored_chunks(spark, folder).collect())

    short = "<h1>Only</h1><p>one section</p>"
    assert stored_chunks(spark, folder) is None
    first = arrive(("a.html", PAGE, 1))
    assert len(first) == 6 and {c[0] for c in first} == {"a.html"}
    second = arrive(("a.html", short, 3), ("b.html", PAGE, 1), ("a.html", PAGE, 2), ("empty.html", "", 1), (None, short, 1))
    assert [c for c in second if c[0] == "a.html"] == [("a.html", "Only", "Only one section")] and len(second) == 7
    assert arrive(("a.html", PAGE, 2)) == second  # late
    table = StoredTable(spark, folder)
    versions = table.versions()
    merge_pages(spark.createDataFrame([("z.html", PAGE, 9)], shape), table, Config(), f"{tmp_path / 'state'}#0")  # a batch that is replayed
    assert table.versions() == versions and sorted((c.source_file, c.title, c.content) for c in stored_chunks(spark, folder).collect()) == second
    assert {r.source_file for r in table.read().collect()} == {"a.html", "b.html", "empty.html"}
