"""Golden checks of Markdown -> blocks -> spans -> batches."""

import json

from pyspark.sql import Row

from captionflow.operators import blocks as B


def _md(spark, text):
    return spark.createDataFrame([Row(video_id="v", md=text)])


def test_blocks_golden(spark):
    md = "\n".join(["# T", "", "## Sub", "### Third", "#### deep", "* a", "- b", "• c", "---", "```bash",
                    "  echo 1", "", "```", "plain **bold** and `code` *stray", "```json", "{}"])
    got = [(r.type, r.language, r.text) for r in B.md_to_blocks(_md(spark, md)).orderBy("block_no").collect()]
    assert got == [("heading_1", None, "T"), ("heading_2", None, "Sub"), ("heading_3", None, "Third"),
                   ("paragraph", None, "#### deep"), ("bulleted_list_item", None, "a"),
                   ("bulleted_list_item", None, "b"), ("bulleted_list_item", None, "c"), ("divider", None, ""),
                   ("code", "bash", "  echo 1\n"), ("paragraph", None, "plain **bold** and `code` *stray")]
    # the unclosed json block is lost


def test_spans_golden(spark):
    md = "plain **bold** and `code` *stray ``" + "\n" + "x" * 2001
    spans = B.rich_text(B.md_to_blocks(_md(spark, md))).orderBy("block_no", "span_no").collect()
    got = [(s.block_no, s.content, s.bold, s.code) for s in spans]
    assert got[:4] == [(0, "plain ", False, False), (0, "bold", True, False), (0, " and ", False, False),
                       (0, "code", False, True)]
    assert got[4] == (0, " ", False, False) and got[5] == (0, "stray ", False, False)
    assert [(b, len(c)) for b, c, _, _ in got[6:]] == [(1, 2000), (1, 1)]


def test_batches_and_payload(spark):
    md = "\n".join(f"line {i}" for i in range(101))
    blocks = B.md_to_blocks(_md(spark, md))
    videos = spark.createDataFrame([Row(video_id="v", title="")])
    p = {r.batch: r for r in B.page_payloads(blocks, videos, database_id="db").collect()}
    assert (p[0].n_children, p[1].n_children) == (100, 1)
    first = json.loads(p[0].payload)
    assert first["properties"]["Name"]["title"][0]["text"]["content"] == "Sem Título"
    assert first["properties"]["URL"]["url"] == "https://www.youtube.com/watch?v=v"
    assert first["children"][0] == {"object": "block", "type": "paragraph",
                                    "paragraph": {"rich_text": [{"type": "text", "text": {"content": "line 0"}}]}}
    assert list(json.loads(p[1].payload)) == ["children"]
