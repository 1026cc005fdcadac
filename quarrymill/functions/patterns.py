"""What marks the parts of a documentation page. They must equal the values users rely on for right results."""

#: Counted on the whole page, in any case of letters.
COUNTS = {
    "h1": r"(?i)<h1[\s>]",
    "h2": r"(?i)<h2[\s>]",
    "h3": r"(?i)<h3[\s>]",
    "h4": r"(?i)<h4[\s>]",
    "h5": r"(?i)<h5[\s>]",
    "h6": r"(?i)<h6[\s>]",
    "code_blocks": r"(?i)<pre[\s>]",
    "tables": r"(?i)<table[\s>]",
    "table_rows": r"(?i)<tr[\s>]",
    "ordered_lists": r"(?i)<ol[\s>]",
    "unordered_lists": r"(?i)<ul[\s>]",
    "html5_videos": r"(?i)<video[\s>]",
    "details": r"(?i)<details[\s>]",
    "definitions": r"(?i)<dl[\s>]",
    "forms": r"(?i)<form[\s>]",
    "tab_classes": r"""(?i)class="[^"]*(?:tabs|tablist|tab-container)[^"]*\"""",
    "tab_roles": r"""(?i)role="tablist\"""",
    "accordion_classes": r"""(?i)class="[^"]*(?:accordion|collapsible|expandable)[^"]*\"""",
    "tooltips": r"""(?i)data-tooltip|class="[^"]*tooltip[^"]*"|aria-describedby""",
    "graphql_explorers": r"""(?i)class="[^"]*(?:graphiql|graphql-explorer|graphql-playground|graphql-ide)[^"]*\"""",
    "math": r"""(?i)class="[^"]*(?:MathJax|katex|math-display|MathJax_Display|math-inline|arithmatex)[^"]*"|<math[\s>]|type="math/tex"|type="[^"]*mathjax""",
    "diagrams": r"""(?i)class="[^"]*(?:mermaid|drawio|diagram-container|plantuml|graphviz|d2-|kroki)[^"]*"|data-mermaid""",
    "code_playgrounds": r"""(?i)iframe[^>]+src="[^"]*(?:codepen\.io|codesandbox\.io|stackblitz\.com|repl(?:it)?\.(?:com|it)|jsfiddle\.net)""",
    "tab_components": r"""(?i)class="[^"]*(?:tabbed-set|tabbed-block|tabs-container|tab-group|tab-panel)[^"]*"|role="tabpanel\"""",
    "code_groups": r"""(?i)class="[^"]*(?:code-group|codegroup|code-tabs|multi-code)[^"]*\"""",
    "accordion_items": r"""(?i)class="[^"]*(?:accordion-item|collapsible-section|toggle-section|disclosure)[^"]*\"""",
    "cards": r"""(?i)class="[^"]*(?:card\s|card"|card-grid|card-container|card-item)[^"]*\"""",
    "steps": r"""(?i)class="[^"]*(?:steps|stepper|step-list|step-item|procedure)[^"]*\"""",
    "badges": r"""(?i)class="[^"]*(?:badge|label|tag|chip)[^"]*\"""",
    "api_fields": r"""(?i)class="[^"]*(?:param-field|response-field|api-field)[^"]*\"""",
    "columns": r"""(?i)class="[^"]*(?:columns|col-\d|grid-cols)[^"]*\"""",
    "playground_marks": r"""(?i)class="[^"]*(?:swagger-ui|redoc-wrap|scalar-app|api-playground|sl-elements|rm-TryItOut|rm-APIMethod|api-explorer|openapi-content|openapi-method|TryItPanel|rm-TryIt|rm-RequestForm|postman-run-button|endpoint-playground|api-tester|api-console|request-builder)[^"]*"|<(?:redoc|rapidoc|rapi-doc|scalar-api-reference|elements-api|bump-api-reference)[\s>]|id="api-playground[^"]*"|class="[^"]*(?:api-section|tryit-button|method-pill|param-field)[^"]*"|data-testid="[^"]*playground[^"]*"|data-postman""",
    "response_panels": r"""(?i)class="[^"]*(?:response-code|response-body|request-body|response-panel|request-panel)[^"]*\"""",
    "parameter_marks": r"""(?i)class="[^"]*(?:param-|parameter|field-list|primitive-param-field|object-param-field|query-param|path-param|header-param|body-param)[^"]*"|class="[^"]*(?:api-field|param-field)[^"]*\"""",
    "method_badges": r"""(?i)class="[^"]*(?:method-badge|http-badge|method-pill|http-method|api-method)[^"]*\"""",
}
FLAGS = {
    "has_pagination": r"""(?i)class="[^"]*pagination[^"]*"|rel="next"|class="[^"]*page-nav[^"]*"|class="[^"]*next-prev[^"]*\"""",
    "has_language_switcher": r"""(?i)class="[^"]*(?:locale|language-switch|lang-select|language-selector)[^"]*"|hreflang""",
    "has_hero": r"""(?i)class="[^"]*(?:hero|banner|landing|jumbotron)[^"]*\"""",
    "has_feature_grid": r"""(?i)class="[^"]*(?:feature|highlights|cards-grid)[^"]*\"""",
    "auth_mark": r"""(?i)class="[^"]*(?:authorization|security-scheme|auth-scheme|api-key|bearer-token)[^"]*\"""",
    "endpoint_mark": r"""(?i)class="[^"]*(?:endpoint-url|endpoint-path|api-path|base-url)[^"]*"|class="[^"]*endpoint[^"]*"[^>]*><code""",
    "schema_mark": r"""(?i)class="[^"]*(?:response-schema|request-schema|schema-table|properties-table)[^"]*"|class="[^"]*model-[^"]*\"""",
    "body_mark": r"""(?i)class="[^"]*(?:param-field|response-field|request-body|response-body)[^"]*\"""",
    "rest_mark": r"""(?i)class="[^"]*(?:swagger-ui|redoc|rest-api)[^"]*\"""",
    "graphql_mark": r"""(?i)graphql|__schema|query\s*\{|mutation\s*\{""",
    "grpc_mark": r"""(?i)grpc|protobuf|\.proto\b""",
    "mdx_mark": r"""(?i)admonition|class="[^"]*tabs""",
}
EMBEDS = {
    "CodePen": r"""(?i)iframe[^>]+src="[^"]*codepen\.io|class="[^"]*codepen""",
    "CodeSandbox": r"""(?i)iframe[^>]+src="[^"]*codesandbox\.io""",
    "StackBlitz": r"""(?i)iframe[^>]+src="[^"]*stackblitz\.com""",
    "Replit": r"""(?i)iframe[^>]+src="[^"]*repl(?:it)?\.(?:com|it)""",
    "JSFiddle": r"""(?i)iframe[^>]+src="[^"]*jsfiddle\.net""",
    "GitHub Gist": r"""(?i)script[^>]+src="[^"]*gist\.github\.com""",
    "RunKit": r"""(?i)iframe[^>]+src="[^"]*runkit\.com|class="[^"]*runkit-embed""",
    "Observable": r"""(?i)iframe[^>]+src="[^"]*observablehq\.com""",
    "Figma": r"""(?i)iframe[^>]+src="[^"]*figma\.com""",
}
WIDGETS = {
    "toggle": r"""(?i)class="[^"]*(?:toggle|switch)[^"]*"|role="switch\"""",
    "slider": r"""(?i)type="range"|class="[^"]*(?:slider|range)[^"]*\"""",
    "calculator": r"""(?i)class="[^"]*calculator[^"]*\"""",
    "playground": r"""(?i)class="[^"]*(?:code-playground|live-editor|interactive-code)[^"]*\"""",
    "poll": r"""(?i)class="[^"]*(?:poll|survey|vote)[^"]*\"""",
    "quiz": r"""(?i)class="[^"]*(?:quiz|question)[^"]*\"""",
}
VIDEO_HOSTS = {"youtube": r"(?i)youtube|youtu\.be", "vimeo": r"(?i)vimeo", "loom": r"(?i)loom\.com", "wistia": r"(?i)wistia"}
NOT_PLAIN_IFRAME = r"(?i)youtube|youtu\.be|vimeo|loom|wistia|zendesk"
DOWNLOADS = [".pdf", ".zip", ".csv", ".xlsx", ".docx", ".dmg", ".exe", ".pkg", ".tar.gz"]

#: API documentation found on a page; the second is looked for only where the first is missing.
API_REFS = {
    "OpenAPI/Swagger UI detected": r"""(?i)class="[^"]*(?:swagger-ui|redoc-wrap)[^"]*"|id="[^"]*(?:swagger|redoc)[^"]*"|<swagger-ui[\s>]|<rapi-doc[\s>]""",
    "OpenAPI/Swagger spec embedded": r"""(?i)["']openapi["']\s*:\s*["']|["']swagger["']\s*:\s*["']""",
    "GraphQL detected": r"""(?i)class="[^"]*graphiql[^"]*"|class="[^"]*graphql-explorer[^"]*\"""",
    "Mintlify API playground detected": r"""(?i)id="api-playground|class="[^"]*(?:openapi-content|openapi-method|tryit-button|method-pill|param-field)[^"]*"|data-testid="[^"]*playground""",
    "Stoplight Elements detected": r"""(?i)<elements-api[\s>]|class="[^"]*(?:sl-elements|TryItPanel|TryIt)[^"]*\"""",
    "Postman integration detected": r"""(?i)postman-run-button|data-postman|postman-embed""",
    "REST API documentation detected": r"""(?i)class="[^"]*(?:api-method|http-method|api-content|endpoint)[^"]*\"""",
    "readme.com API docs detected": r"""(?i)name=["']readme-deploy["']|class="[^"]*rdmd[^"]*\"""",
}
#: Tool, mark, whether it has a playground, whether requests can be tried.
API_TOOLS = [
    ("swagger-ui", r"""(?i)class="[^"]*swagger-ui[^"]*\"""", True, True),
    ("redoc", r"""(?i)class="[^"]*redoc-wrap[^"]*"|<redoc[\s>]""", False, False),
    ("scalar", r"""(?i)scalar-app|<scalar-api-reference[\s>]""", True, True),
    ("rapidoc", r"""(?i)<rapidoc[\s>]|<rapi-doc[\s>]""", True, True),
    ("stoplight", r"""(?i)<elements-api[\s>]|class="[^"]*(?:sl-elements|TryItPanel|TryIt)[^"]*\"""", True, True),
    ("bump", r"""(?i)<bump-api-reference[\s>]""", False, False),
    ("mintlify-api", r"""(?i)id="api-playground|class="[^"]*(?:openapi-content|openapi-method|param-field)[^"]*"|data-testid="[^"]*playground""", True, True),
    ("readme", r"""(?i)rm-TryItOut|rm-APIMethod|rm-TryIt|rm-RequestForm|name=["']readme-deploy["']""", True, True),
    ("postman", r"""(?i)postman-run-button|data-postman|postman-embed""", True, False),
    ("insomnia", r"""(?i)class="[^"]*insomnia-[^"]*\"""", True, False),
    ("graphiql", r"""(?i)class="[^"]*graphiql[^"]*\"""", True, True),
    ("graphql-playground", r"""(?i)class="[^"]*graphql-playground[^"]*\"""", True, True),
]
AUTH_METHODS = {"Bearer": r"(?i)bearer|authorization.*bearer", "API Key": r"(?i)api[_-]?key", "OAuth2": r"(?i)oauth", "Basic": r"(?i)basic.*auth"}
PLAYGROUND_TYPES = {
    "swagger-ui": r"""(?i)class="[^"]*swagger-ui[^"]*\"""",
    "redoc": r"""(?i)class="[^"]*redoc-wrap[^"]*"|<redoc[\s>]""",
    "rapidoc": r"""(?i)<rapidoc[\s>]|<rapi-doc[\s>]""",
    "scalar": r"""(?i)scalar-app|<scalar-api-reference[\s>]""",
    "stoplight": r"""(?i)<elements-api[\s>]|class="[^"]*(?:sl-elements|TryItPanel|TryIt)[^"]*\"""",
    "bump": r"""(?i)<bump-api-reference[\s>]""",
    "mintlify-api": r"""(?i)class="[^"]*(?:api-playground|openapi-content|openapi-method|param-field)[^"]*"|id="api-playground|data-testid="[^"]*playground""",
    "readme": r"""(?i)rm-TryItOut|rm-APIMethod|rm-TryIt|rm-RequestForm|TryItNow""",
    "postman": r"""(?i)postman-run-button|data-postman|postman-embed""",
    "insomnia": r"""(?i)class="[^"]*insomnia-[^"]*\"""",
    "generic": r"""(?i)class="[^"]*(?:api-explorer|endpoint-playground|api-tester|api-console)[^"]*\"""",
}
PLAYGROUND_PATH = r"/(?:api-reference|api-playground|api-explorer|playground|try-it|tryit|swagger|redoc|graphql-playground|graphiql)(?:/|$)"
API_PATH = r"/(?:api-reference|api-ref|reference/api|api/v?\d|apis/)"

#: Platform, what the generator tag may name, marks of which one must occur (each a list that must occur together), whether on the page or its url.
PLATFORMS = [
    ("docusaurus", "docusaurus", [[r"""__docusaurus_skipToContent_fallback|id="__docusaurus"|theme-doc-markdown"""]]),
    ("mkdocs", "mkdocs", [[r"""md-typeset|id="__md"|class="[^"]*md-content"""]]),
    ("gitbook", None, [[r"""data-testid="page\.contentEditor"|gitbook-root"""]]),
    ("vitepress", "vitepress", [[r"""id="VPContent"|VPDoc|vp-doc"""]]),
    ("readthedocs", None, [[r"""readthedocs-data\.js|readthedocs\.io|readthedocs\.org"""], ["rst-content", "data-project="]]),
    ("sphinx", "sphinx", [["sphinxsidebarwrapper|DOCUMENTATION_OPTIONS|rst-content"]]),
    ("nextra", "nextra", [[r"""nextra-sidebar-container|class="[^"]*nextra"""]]),
    ("starlight", None, [[r"""id="starlight__sidebar"|starlight-theme-select|sl-markdown-content"""], ["generator:astro", "starlight"]]),
    ("fumadocs", None, [["fumadocs"]]),
    ("readme", None, [[r"""readme-deploy|readme-tailwind|class="[^"]*rdmd|id="hub-header\""""]]),
    ("hugo-docsy", None, [["td-content", "docsy"]]),
    ("jekyll", "jekyll", []),
    ("zendesk", None, [["powered-by-zendesk|HelpCenter"], ["url:/hc/[a-z]{2}"]]),
    ("docsify", None, [[r"window\.\$docsify|data-docsify"]]),
    ("google-devsite", None, [["devsite-main-content|devsite-article|clouddocs-homepage"]]),
    ("mintlify", "mintlify", [[r"""class="[^"]*mintlify"""]]),
    ("wikijs", None, [[r"""id="wiki-app"|wiki-page"""]]),
    ("slate", "slate", [["tocify", "page-wrapper"]]),
    ("notion", None, [["notion-page-content"]]),
    ("confluence", None, [[r"""confluence-information-macro|class="[^"]*wiki-content"""]]),
]
FORMATS = {
    "mdx": ["nextra", "fumadocs", "mintlify"],
    "markdown": ["mkdocs", "vitepress", "jekyll", "hugo-docsy", "starlight", "docsify", "wikijs"],
    "rst": ["sphinx", "readthedocs"],
    "html": ["gitbook", "readme", "notion", "confluence", "zendesk", "google-devsite", "slate"],
}
CALLOUT = r"""(?i)class="[^"]*(?:admonition|callout|alert|notice|hint|attention)[^"]*\""""
VARIANTS = {"warning": "warning|caution|attention", "tip": "tip|hint|suggestion", "info": "info|information|seealso", "danger": "danger|error|critical", "check": "check|success|done"}

#: Paths that never lead to documentation.
NON_DOC_PATHS = [
    r"/(signin|signup|sign-in|sign-up|login|logout|log-in|log-out)(/|$)", r"/(oauth|sso)(/|$)", r"/auth/", r"/(account|profile|settings|preferences)(/|$)",
    r"/(password|forgot-password|reset-password)(/|$)", r"/community(/|$)", r"/(posts|topics)/(new|create)(/|$)", r"/(contributions|subscriptions|following)(/|$)",
    r"/search(\?|/|$)", r"/requests/new(/|$)", r"/(pricing|plans)(/|$)", r"/(contact|contact-us|feedback)(/|$)", r"/(cart|checkout|subscribe|unsubscribe)(/|$)",
    r"/(admin|dashboard)(/|$)", r"/(blog|news|press|announcements)(/|$)", r"/(shop|store)(/|$)", r"/(404|500|error)(/|$)", r"/(status|changelog|releases|release-notes)(/|$)",
    r"/(redirect|share|print)(/|$)", r"/(careers|jobs|legal|terms|privacy|cookie)(/|$)", r"/(forum|discuss|discussions)(/|$)", r"/(marketplace|plugins|extensions)(/|$)",
    r"/(embed|widget)(/|$)", r"/amp(/|$)", r"/print(/|$)", r"/_sources/", r"/(genindex|py-modindex|modindex)(\.html)?(/|$)", r"/objects\.inv$", r"/_static/", r"/_images/",
    r"/_downloads/", r"/_modules/", r"\.rst(\.txt)?$", r"\.md\.txt$", r"/(assets|static|_next|_nuxt|__docusaurus)/", r"/(feed|sitemap)(\.xml)?(/|$)", r"/tags?/", r"/page/\d+",
    r"/search(\.html)?(/|$)",
]
NON_DOC_EXTENSIONS = r"\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|eot|pdf|zip|rst|rst\.txt|md\.txt|inv)$"
