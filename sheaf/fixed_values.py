"""Lists, tables and constants results depend on. Stated as they must be, in natural order."""

# --- accepted file extensions (three presets) ---
UPLOAD_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".txt", ".md", ".xls", ".xlsx", ".csv", ".ppt", ".pptx",
    ".png", ".jpg", ".jpeg", ".tiff", ".bmp",
)
BATCH_EXTENSIONS = (
    ".pdf", ".md", ".txt", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx",
    ".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif",
)
CONFIG_EXTENSIONS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".gif", ".webp",
    ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".txt", ".md",
)
MAX_UPLOAD_BYTES = 100 * 1024 * 1024

# --- page noise ---
NOISE_TAGS = (
    "script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript", "svg",
    "canvas", "object", "ad", "advertisement", "popup", "modal", "cookie-banner",
)
NOISE_CLASSES = (
    "ad", "ads", "advertisement", "banner", "popup", "modal", "cookie", "footer", "header", "nav",
    "sidebar", "menu", "social", "share", "comment", "related", "recommended", "newsletter",
    "subscription", "promo", "tracking", "analytics", "widget", "toast", "notification",
)
ANTI_BOT_PHRASES = (
    "cloudflare", "checking your browser", "please wait while we verify", "ddos protection",
    "antibot", "verifycode", "captcha", "recaptcha", "hcaptcha", "turnstile",
    "access denied", "blocked", "rate limit", "too many requests", "forbidden", "unauthorized",
    "bot detected", "automated access", "suspicious activity", "security check", "challenge page",
    "验证码", "人机验证", "安全验证", "访问验证", "请稍等", "正在检测",
)
LINK_SKIP_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".pdf", ".zip")

# --- link rules ---
FILE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp",
    ".mp4", ".avi", ".mov", ".wmv", ".flv", ".webm",
    ".mp3", ".wav", ".ogg", ".flac",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".css", ".js", ".ico", ".svg", ".woff", ".woff2", ".ttf",
    ".exe", ".dmg", ".apk", ".msi",
)
SOCIAL_DOMAINS = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "tiktok.com",
    "snapchat.com", "pinterest.com", "reddit.com", "youtube.com", "twitch.tv",
)
URL_BODY = (
    r"(?:http|ftp)s?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|"
    r"localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)"
)

# --- search results ---
BLOCKED_URL_PATTERNS = (
    "kuaidi100.com", "ickd.cn", "sto.cn", "sf-express.com", "yundaex.com",
    "zto.com", "yto.net.cn", "deppon.com", "jiayu.cn",
    "dict.", "zidian.", "baike.baidu.com/item/",
    "tianyancha.com", "qichacha.com", "qixin.com",
    "douyin.com", "kuaishou.com", "bilibili.com/video",
    "porn", "xxx", "vip", "bet", "casino",
)
BLOCKED_TITLE_PATTERNS = (
    "快递", "物流", "查询快递", "单号查询", "查快递",
    "百度百科", "汉语词典", "字典", "词典",
    "天眼查", "企查查", "启信宝", "抖音", "快手",
)
AUTHORITY_WORDS = ("官方", "政府", "教育部", "gov.cn", "edu.cn", "新华社")
ENGINES = ("Bing", "Baidu", "Sogou")
CHART_WORDS = (
    "折线图", "柱状图", "饼图", "散点图", "图表", "画图", "可视化", "统计图",
    "line chart", "bar chart", "pie chart", "scatter plot", "chart", "graph", "visualization",
)
ANALYSIS_WORDS = (
    "数据分析", "统计分析", "趋势分析", "对比分析", "提取数据", "数据提取", "数据处理",
    "data analysis", "analyze data", "extract data", "statistics", "trend", "compare",
)
DETAIL_WORDS = ("详细", "detailed", "详细地", "详细说明", "详细解释")
FILLER_WORDS = (
    "帮我搜索一下", "帮我搜一下", "帮我查一下", "帮我找一下",
    "查一下", "查一查", "查查", "查看看", "查一个", "查个",
    "帮我查", "帮我找", "帮我搜", "帮我搜索",
    "查询一下", "搜索一下", "查找一下", "检索一下",
    "搜一下", "搜搜", "搜一个", "搜个",
    "找一下", "找一找", "找找", "找一个", "找个",
    "看一下", "看一看", "看看", "看一个", "看个",
    "请问", "想问", "想知道", "我想知道", "我想了解",
    "麻烦", "能不能", "可不可以", "是否", "有没有",
    "是什么", "什么是", "怎么样", "如何", "怎么",
    "请", "求", "告诉我", "来一个", "给一个",
    "查询", "搜索", "查找", "检索",
    "一下", "一个", "一次", "一些", "有关", "关于",
    "情况", "内容", "方面", "信息", "数据", "资料",
)
QUERY_STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很",
    "到", "说", "要", "去", "你", "会", "着", "没", "看", "好", "自己", "这", "他", "她", "它", "们",
    "那", "哪", "什么", "怎么", "如何", "为什么", "可以", "吗", "呢", "吧", "啊", "哦", "嗯", "呀",
    "嘛", "呵", "哈", "哇", "哟", "噢", "请", "让", "把", "被", "给", "跟", "对", "从",
    "于", "向", "由", "用", "以", "而", "且", "或", "但", "如果", "因为", "所以", "虽然", "然而",
    "不过", "还是", "只是", "就是", "还有", "或者", "这个", "那个", "这些", "那些", "这里", "那里",
    "现在", "目前", "今天", "昨天", "明天", "非常", "真的", "比较", "更加", "越来越",
    "已经", "曾经", "将会", "可能", "应该", "需要", "必须", "能够", "得", "地", "之", "等", "等等",
    "多", "少", "多少", "几", "一些", "一点", "时", "时候", "年", "月", "日", "天",
    "前", "后", "里", "外", "中", "内", "间", "下面", "上面", "前面", "后面", "旁边",
)

# --- conversations ---
MODEL_CONTEXT_SIZES = (
    ("gpt-4", 8192), ("gpt-4-32k", 32768), ("gpt-4-turbo", 128000), ("gpt-4o", 128000),
    ("gpt-4o-mini", 128000), ("gpt-3.5-turbo", 16385),
    ("gemini-1.5-flash", 1048576), ("gemini-1.5-pro", 2097152), ("gemini-2.0-flash", 1048576),
    ("gemini-2.5-flash", 1048576), ("gemini-2.5-pro", 1048576),
    ("claude-3-opus", 200000), ("claude-3-sonnet", 200000), ("claude-3-haiku", 200000),
    ("deepseek-chat", 65536), ("deepseek-reasoner", 65536),
    ("qwen-max", 32768), ("qwen-plus", 131072),
)
DEFAULT_CONTEXT_SIZE = 128000
COMPLETION_RESERVE = 4096
DEDUP_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
    "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "out", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "about", "up", "it",
    "its", "this", "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him",
    "his", "she", "her", "they", "them", "their", "what", "which", "who", "whom",
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很",
    "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
)
RULE_PATTERNS = (
    r"(?:MUST|ALWAYS|NEVER|DO NOT|IMPORTANT|CRITICAL|REQUIRED)[^.]*\.",
    r"(?:必须|始终|绝不|不要|重要|关键|务必)[^。]*。",
)
RULES_HEADING = "[CRITICAL INSTRUCTIONS — must follow these rules in every response]:\n"
OVERVIEW_HEADING = "[Session Overview — key points from the entire conversation]:\n"
RECAP_HEADING = "[Key points from earlier in this conversation — pay attention to these]:\n"
REPEAT_HEADING = "[Previously answered similar questions — DO NOT repeat]:\n"
SUMMARY_HEADING = "[Conversation History Summary]:\n"
MEMORY_HEADING = "[Relevant User Memories]:\n"
MEMORY_FOOTER = "\nUse the above memories to personalize your response when relevant."
RAG_HEADING = "[Retrieved knowledge base context]:\n\n"
RAG_REPLY = "I've reviewed the retrieved context and will use it to answer."
ATTENTION_GUIDANCE = (
    "IMPORTANT: Pay equal attention to ALL parts of the context provided, "
    "including information that appears in the middle of the conversation history. "
    "Do not overlook or forget any details mentioned earlier in the conversation."
)
ANTI_REPETITION = (
    "CRITICAL: The user is asking a follow-up question in an ongoing conversation. "
    "Do NOT repeat information you have already provided in earlier turns. "
    "Only provide NEW information that directly addresses the user's current question. "
    "If you have already answered a similar question, reference that answer briefly "
    "and add only the new details the user is seeking."
)

# --- memory ---
MEMORY_TYPES = (
    ("raw", 1, "Raw Conversation"),
    ("semantic", 2, "Semantic Knowledge"),
    ("episodic", 4, "Episodic Memory"),
    ("procedural", 8, "Procedural Memory"),
)

# --- chunk templates for modal items ---
IMAGE_CHUNK = (
    "\nImage Content Analysis:\n- Section Path: %s\n- Neighbor Text: %s\nImage Path: %s\n"
    "Captions: %s\nFootnotes: %s\n\nVisual Analysis: %s"
)
TABLE_CHUNK = (
    "Table Analysis:\nImage Path: %s\nCaption: %s\nStructure: %s\nFootnotes: %s\n\nAnalysis: %s"
)
EQUATION_CHUNK = (
    "Mathematical Equation Analysis:\nEquation: %s\nFormat: %s\n\nMathematical Analysis: %s"
)
GENERIC_CHUNK = "%s Content Analysis:\nContent: %s\n\nAnalysis: %s"

# Where stored results pages hold their results. A selector is an element or a class, or one inside another.
RESULT_LAYOUTS = {
    "Bing": {"within": "#b_results", "result": [".b_algo"], "title": ["h2 a"], "snippet": [".b_caption p"]},
    "Baidu": {"within": "#content_left", "result": [".result", ".result-op"], "title": [".t a", ".c-title a"],
              "snippet": [".c-abstract", ".c-span-last"]},
    "Sogou": {"within": ".results", "result": [".vrwrap", ".txt-box"], "title": [".vr-title a", "h3 a"],
              "snippet": [".star-wiki", ".attribute-centent", ".txt-info"]},
}
RESULT_PAGE_BLOCKS = ("antibot", "verifycode", "captcha")
RESULT_ROOTS = {"Baidu": "https://www.baidu.com"}
RESULT_LINK_STARTS_OUT = {"Baidu": ("#", "javascript:")}
RESULT_LINKS_OUT = {"Baidu": ("baidu.com/search/", "baidu.com/cache/", "baidu.com/snap/", "baidustatic.com")}
