import json

from pyspark.sql import functions as F

from pageledger.fixed_values import EXCLUDED_KEYWORDS
from pageledger.operators import suggest
from pageledger.operators.pages import extract_content

EXPECTED = (
    "You are an expert SEO assistant.\nGiven the following HTML content for the page at https://x.org/a, suggest an improved, concise, and "
    "relevant <title> (max 60 characters), meta description (max 155 characters), and a set of 3-4 SEO keywords (comma-separated, no "
    "hashtags) for SEO.\nDont suggest the following keywords: Port Authority, Redevelopment, New York, New Jersey. \n"
)


def prompts(spark, html, listed=None, **options):
    pages = spark.createDataFrame([("x.org", "https://x.org/a", html)], "site string, url string, html string")
    content = extract_content(pages.withColumn("kept", F.col("html"))).withColumnRenamed("kept", "html")
    keyword_list = None if listed is None else spark.createDataFrame([(listed,)], "keyword_list string")
    return suggest.prompt(suggest.select_requests(content), keyword_list, **options)


def test_prompt_parts(spark):
    tail = "\n---\nRespond in JSON with keys 'suggestedTitle', 'suggestedDescription', and 'suggestedKeywords'."
    assert "Dont suggest" not in prompts(spark, "<body>text</body>").head().prompt
    bare = prompts(spark, "<body>text</body>", excluded=EXCLUDED_KEYWORDS).head().prompt
    assert bare == EXPECTED + "\nHTML:\ntext" + tail
    full = prompts(
        spark, '<title>T</title><meta name=description content="D"><meta name=keywords content="K"><body>' + "x" * 5000, "k1, k2", excluded=()
    )
    assert full.head().prompt == (
        EXPECTED.split("Dont suggest")[0]
        + "\nSuggest new keywords and also include any from this list when appropriate: k1, k2"
        + '\nCurrent title: "T"\nCurrent description: "D"\nCurrent keywords: "K"\nHTML:\n'
        + "x" * 4000
        + tail
    )
    request = json.loads(suggest.request_records(full).head().request)
    assert [message["role"] for message in request["messages"]] == ["system", "user"]
    assert (request["max_tokens"], request["temperature"], request["response_format"]) == (350, 0.7, {"type": "json_object"})


def test_good_pages_are_not_asked_for(spark):
    good = (
        "<title>A title that is long enough</title><meta name=keywords content=a>"
        '<meta name=description content="' + "d" * 100 + '">'
    )
    assert prompts(spark, good).count() == 0
    assert prompts(spark, good.replace("d" * 100, "d" * 10)).count() == 1


def test_answers(spark):
    answers = {
        '{"suggestedTitle":"T","suggestedDescription":"D","suggestedKeywords":"A, B"}': ("T", "D", "a, b"),
        '{"suggestedTitle":"T \\"q\\"","suggestedKeywords":["A","B"]}': ("T \\", None, None),
        '{"suggestedTitle":"T","suggestedKeywords":5}': ("T", None, None),
        '{"suggestedTitle":"T","suggestedKeywords":true}': ("T", None, None),
        '{"suggestedTitle":"T \\u00e9","suggestedKeywords":null}': ("T é", None, None),
        '{"suggestedTitle":"T \\u00e9","suggestedKeywords":0}': ("T é", None, None),
        '{"suggestedTitle":"T \\u00e9","suggestedKeywords":""}': ("T é", None, None),
        '{"suggestedTitle" : "T","suggestedKeywords": "A, B"': ("T", None, "a, b"),
        "no json": (None, None, None),
        "[1]": (None, None, None),
        "": (None, None, None),
    }
    rows = [(str(at), content) for at, content in enumerate(answers)] + [("none", None)]
    frame = spark.createDataFrame(rows, "url string, content string")
    parsed = frame.select("url", suggest.parse_response(F.col("content")).alias("a")).collect()
    found = {row.url: tuple(row.a) for row in parsed}
    assert found == {**{str(at): answer for at, answer in enumerate(answers.values())}, "none": (None, None, None)}


def test_pages_without_answer_get_none(spark):
    pages = spark.createDataFrame([("1",), ("2",)], "url string")
    responses = spark.createDataFrame([("1", '{"suggestedTitle":"T"}')], "url string, content string")
    rows = {row.url: row.suggested_title for row in suggest.attach_suggestions(pages, responses).collect()}
    assert rows == {"1": "T", "2": None}
