"""Constants, labels and text formats that results must carry exactly.

They are plain data.  Changing one changes what the audit reports, so they are kept together here.
"""

# --- scores ---------------------------------------------------------------------------------
GOOD = "good"
NEEDS_IMPROVEMENT = "needs improvement"
# both bounds are exclusive
TITLE_BOUNDS = (10, 70)
DESCRIPTION_BOUNDS = (50, 160)
KEYWORD_BOUNDS = (0, 10)
SINGLE_H1 = 1

# --- audit run defaults ----------------------------------------------------------------------
DEFAULT_DEPTH = 3
DEFAULT_LIMIT = 100
HTTP_ERROR_PREFIX = "HTTP error! Status: "

# --- site key --------------------------------------------------------------------------------
SITE_KEY_FALLBACK = "site-cache"

# --- CSV report: output name, page column ----------------------------------------------------
CSV_COLUMNS = (
    ("url", "url"),
    ("title", "title"),
    ("suggestedTitle", "suggested_title"),
    ("description", "description"),
    ("suggestedDescription", "suggested_description"),
    ("keywords", "keywords"),
    ("suggestedKeywords", "suggested_keywords"),
    ("ogImage", "og_image"),
)

# --- summary table: label, count column, percentage column (None: the fixed text 100) ---------
SUMMARY_ROWS = (
    ("Total Pages", "total_pages", None),
    ("Pages with Title", "pages_with_title", "title_completeness"),
    ("Pages with Description", "pages_with_description", "description_completeness"),
    ("Pages with Keywords", "pages_with_keywords", "keywords_completeness"),
    ("Pages with H1", "pages_with_h1", "h1_completeness"),
    ("Pages with Canonical URL", "pages_with_canonical", "canonical_completeness"),
    ("Pages with Open Graph Tags", "pages_with_og_tags", "og_tags_percentage"),
    ("Pages with Twitter Tags", "pages_with_twitter_tags", "twitter_tags_percentage"),
    ("Pages in Sitemap", "pages_in_sitemap", "in_sitemap_percentage"),
    ("Pages not in Sitemap", "pages_not_in_sitemap", "not_in_sitemap_percentage"),
    ("Pages with Title Issues", "pages_with_title_issues", "title_issues_percentage"),
    ("Pages with Description Issues", "pages_with_description_issues", "description_issues_percentage"),
    ("Pages with H1 Issues", "pages_with_h1_issues", "h1_issues_percentage"),
    ("Pages with Errors", "pages_with_errors", "errors_percentage"),
)
SUMMARY_ROW_FORMAT = "<tr><td>{label}</td><td>{count}</td><td>{percentage}%</td></tr>"

# --- HTML page row: one cell per entry; {0} is the escaped value -------------------------------
HTML_CELL_NOWRAP = '<td class="nowrap">{0}</td>'
HTML_CELL_PLAIN = "<td>{0}</td>"
HTML_CELL_LINK = '<td class="nowrap"><a href="{0}" target="_blank">{0}</a></td>'
HTML_CELL_SCORE = '<td class="nowrap"><span class="score-{1}">{0}</span></td>'
HTML_CELL_SITEMAP = '<td class="nowrap"><span class="{1}">{0}</span></td>'
HTML_CELL_ERROR = '<td class="nowrap error">{0}</td>'
HTML_SCORE_CLASSES = ("good", "bad")
HTML_SITEMAP_CLASSES = ("in-sitemap", "not-in-sitemap")
HTML_SITEMAP_TEXT = ("Yes", "No")
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))

# --- keyword files ----------------------------------------------------------------------------
KEYWORD_HEADERS = ("keyword", "keywords", "search term", "term", "query")
CLICK_HEADERS = ("clicks", "click")
IMPRESSION_HEADERS = ("impressions", "impression")
TOP_KEYWORDS = 20
TOP_BY_METRIC = 50

# --- suggestion requests ------------------------------------------------------------------------
EXCLUDED_KEYWORDS = ("Port Authority", "Redevelopment", "New York", "New Jersey")
PROMPT_TEXT_UNITS = 4000
PROMPT_HEAD = "You are an expert SEO assistant.\nGiven the following HTML content for the page at "
PROMPT_TASK = (
    ", suggest an improved, concise, and relevant <title> (max 60 characters), meta description "
    "(max 155 characters), and a set of 3-4 SEO keywords (comma-separated, no hashtags) for SEO.\n"
)
PROMPT_EXCLUDE = ("Dont suggest the following keywords: ", ". \n")
PROMPT_KEYWORDS = "\nSuggest new keywords and also include any from this list when appropriate: "
PROMPT_TITLE = '\nCurrent title: "'
PROMPT_DESCRIPTION = '\nCurrent description: "'
PROMPT_CURRENT_KEYWORDS = '\nCurrent keywords: "'
PROMPT_TEXT = "\nHTML:\n"
PROMPT_TAIL = (
    "\n---\nRespond in JSON with keys 'suggestedTitle', 'suggestedDescription', and 'suggestedKeywords'."
)
REQUEST_MODEL = "gpt-4.1-2025-04-14"
REQUEST_SYSTEM = "You are a helpful assistant for SEO metadata optimization."
REQUEST_FORMAT = "json_object"
REQUEST_MAX_TOKENS = 350
REQUEST_TEMPERATURE = 0.7
RESPONSE_KEYS = ("suggestedTitle", "suggestedDescription", "suggestedKeywords")

# --- content targets ------------------------------------------------------------------------------
DEFAULT_TARGET = "aem"
SKIPPED_TARGETS = ("wordpress", "drupal")
DEFAULT_PROPERTY_MAP = {"title": "jcr:title", "description": "cq:description", "keywords": "cq:keywords"}
TAG_PROPERTY = "cq:tags"
TAG_ROOT = "/cq:tags/"
TYPE_HINT_SUFFIX = "@TypeHint"
TYPE_HINT = "String[]"
CONTENT_NODE = "/jcr:content"
REPLICATE_PROPERTY = ":operation"
REPLICATE_VALUE = "replicate"
MISSING_AUTHOR_URL = "authorUrl is required for AEM push"
