"""Word lists, patterns and weights that results depend on. They must stay as they are."""

# Domains that are never collected.
EXCLUDED_DOMAINS = (
    "duckduckgo.com", "youtube.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "pinterest.com", "weibo.com",
    "xiaohongshu.com", "tumblr.com", "bilibili.com", "youku.com", "iqiyi.com", "tv.sohu.com", "le.com", "pptv.com", "taobao.com", "tmall.com",
    "jd.com", "aliexpress.com", "1688.com", "pdd.com", "suning.com", "toutiao.com", "mp.weixin.qq.com", "baike.sogou.com", "ima.qq.com",
    "baijiahao.baidu.com", "haokan.baidu.com", "mbd.baidu.com", "sohu.com", "163.com", "ifeng.com", "sina.com.cn", "astrologyanswers.com",
    "astrology.com", "horoscope.com", "chinesefortunecalendar.com", "yourchineseastrology.com", "webmd.com", "mayoclinic.org", "healthline.com",
    "match.com", "eharmony.com", "tinder.com",
)
EXCLUDED_SUFFIXES = (".baijiahao.baidu.com", ".haokan.baidu.com", ".sina.com.cn", ".k.sina.com.cn", ".astro.com", ".horoscope.com", ".zodiac.com", ".tarot.com")
EXCLUDED_DOMAIN_PATHS = (("sohu.com", "/a/"), ("163.com", "/dy/"), ("ifeng.com", "/c/"), ("baidu.com", "/p/"), ("baidu.com", "/thread-"))
SEARCH_PATHS = (("google.com", "/search"), ("bing.com", "/search"), ("baidu.com", "/s?"), ("baidu.com", "/search"))
EXCLUDED_PATHS = (
    "/tag/", "/tags/", "/category/", "/categories/", "/search?", "/query?", "/s?", "/find?", "/login", "/register", "/signup", "/auth/", "/cart",
    "/checkout", "/order", "/buy", "/rss", "/feed", "/atom", "/print", "/share", "/email", "/amp/", "/promo", "/affiliate", "/ref=", "/utm_",
)
EXCLUDED_EXTENSIONS = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".zip", ".rar", ".tar.gz")
EXCLUDED_KEYWORDS = ("horoscope", "zodiac", "astrology", "tarot", "daily horoscope", "weekly horoscope", "birth chart", "love compatibility")

# Source authority: score 95, 80, 60 by suffix; excluded 5; others 50.
OFFICIAL_DOMAINS = (
    "docs.spring.io", "spring.io", "docs.python.org", "python.org", "developer.mozilla.org", "mdn.dev", "kubernetes.io", "istio.io", "envoyproxy.io",
    "react.dev", "vuejs.org", "angular.io", "docs.github.com", "github.blog", "aws.amazon.com", "cloud.google.com", "azure.microsoft.com",
    "docs.oracle.com", "dev.mysql.com", "postgresql.org", "redis.io", "mongodb.com", "prometheus.io", "grafana.com", "openai.com", "anthropic.com",
    "platform.openai.com", "huggingface.co", "paperswithcode.com", "arxiv.org", "dl.acm.org", "ieeexplore.ieee.org", "academic.microsoft.com",
    "scholar.google.com",
)
COMMUNITY_DOMAINS = (
    "medium.com", "dev.to", "hashnode.dev", "stackoverflow.com", "stackexchange.com", "infoq.com", "infoq.cn", "juejin.cn", "segmentfault.com",
    "csdn.net", "blog.csdn.net", "zhihu.com", "v2ex.com", "lobste.rs", "news.ycombinator.com", "reddit.com", "producthunt.com",
    "hackernewsletter.com", "ruanyifeng.com", "draveness.me", "cnblogs.com",
)
BLOG_SUFFIXES = ("github.io", "github.com", "gitlab.io", "netlify.app", "vercel.app")

# Content quality.
CLICKBAIT = (
    "震惊", "绝了", "逆天", "炸裂", "颠覆", "史诗", "神级", "99%的人不知道", "看完我沉默了", "后悔没早点", "太可怕了", "万万没想到", "不可思议", "惊人", "史上最强", "全网首发",
    "独家揭秘", "内幕", "震惊中外", "轰动", "爆款", "疯传", "shocking", "unbelievable", "mind-blowing", "epic", "you won't believe", "this changes everything",
)
ADS = ("限时优惠", "点击购买", "立即下单", "免费试用", "优惠券", "折扣码", "推广链接", "affiliate", "赞助内容", "广告合作", "扫码领取", "关注公众号", "限量", "秒杀", "抢购", "不容错过", "错过等一年")
PAYWALL = ("subscribe to read", "membership required", "premium content", "登录后阅读", "订阅后查看", "会员专属", "付费阅读", "sign up to continue", "create an account")

# Page types.
SERP_URLS = ("/search?", "/s?", "/query?", "/find?", "baidu.com/s", "baidu.com/search", "google.com/search", "bing.com/search", "sogou.com/web", "so.com/s", "m.sm.cn/s")
SERP_ROOTS = ("baidu.com", "www.baidu.com", "m.baidu.com", "google.com", "www.google.com", "bing.com", "www.bing.com", "sogou.com", "www.sogou.com", "so.com", "www.so.com", "sm.cn", "m.sm.cn")
SERP_UI = (r"约[\d,]+条结果", r"约[\d,]+个结果", "相关搜索", "相关推荐", "大家还在搜", "下一页", "上一页", "People also ask", "Related searches")
SERP_TITLES = ("百度一下", "百度搜索", "google", "bing", "搜狗搜索", "搜狗")
SERP_TITLE_WORDS = ("search", "搜索", "results", "结果")
LISTING_URLS = ("/tag/", "/tags/", "/category/", "/categories/", "/archives/", "/archive/", "/page/", "/author/")
FORUM_URLS = ("/forum-", "/thread-", "/f/", "/t/", "/topic-", "/board-")
FORUM_UI = (r"\d+\s*(回复|条回复|评论)", r"\d+\s*(浏览|查看)", "最后回复", "最后发表", "置顶", "精华", "加精", "版主", "楼主", "沙发", "板凳", "地板")
LOGIN_SEGMENTS = ("login", "signin", "sign-in", "auth/", "register", "signup", "sign-up", "oauth/", "sso/", "cas/")
LOGIN_TEXT = ("忘记密码", "找回密码", "重置密码", "注册账号", "还没有账号", "新用户注册", "Forgot password", "Reset password", "Create account", "Sign up", "记住我", "Remember me")
ERROR_TITLES = (
    "404", "page not found", "页面未找到", "找不到页面", "not found", "页面不存在", "403", "forbidden", "禁止访问", "500", "internal server error", "服务器错误",
    "服务器内部错误", "bad request", "service unavailable",
)
PAYWALL_TEXT = ("解锁全文", "展开剩余", "展开全文", "查看完整内容", "会员免费读", "开通会员", "订阅全文", "购买后查看", "付费阅读", r"VIP\s*(专享|免费|特权)", r"剩余\s*\d+%\s*内容", r"已加载\s*\d+%")
PAYWALL_URLS = ("/premium/", "/paywall/", "/member/", "/subscribe/", "/purchase/", "/vip/", "/paid/")

# Categories by path, by domain, by title; the first that matches counts.
CATEGORY_PATHS = (
    (r"github\.com/[^/]+/[^/]+/(?:blob|tree)/main/(?:docs?|blog|posts?|_posts)", "tech_article"),
    (r"github\.com/[^/]+/[^/]+/(?:issues|discussions)/\d+", "tech_article"),
    (r"github\.com/[^/]+/[^/]+/releases/tag/", "open_source"),
    (r"medium\.com/[^/]+/(?:[^/]+-)?[a-f0-9]{8,}", "tech_article"),
    (r"reddit\.com/r/\w+/comments/", "hot_trend"),
)
CATEGORY_DOMAINS = {
    "open_source": (
        "github.com", "gitlab.com", "gitee.com", "npmjs.com", "pypi.org", "pkg.go.dev", "crates.io", "gitlab.io", "netlify.app", "vercel.app", "huggingface.co",
        "ossinsight.io", "openjsf.org", "apache.org", "cncf.io", "rust-lang.org", "python.org", "nodejs.org", "deno.land", "bun.sh", "dev.to",
    ),
    "paper": (
        "arxiv.org", "paperswithcode.com", "dl.acm.org", "ieeexplore.ieee.org", "scholar.google.com", "academic.microsoft.com", "semanticscholar.org",
        "openreview.net", "dblp.org",
    ),
    "dev_tool": (
        "producthunt.com", "jetbrains.com", "code.visualstudio.com", "marketplace.visualstudio.com", "docker.com", "postman.com", "figma.com", "notion.so",
        "linear.app", "vercel.com", "render.com", "fly.io",
    ),
    "hot_trend": (
        "hackernewsletter.com", "news.ycombinator.com", "github.blog", "techcrunch.com", "thenewstack.io", "infoq.com", "infoq.cn", "36kr.com", "ithome.com",
        "sspai.com", "theverge.com", "arstechnica.com", "wired.com", "bleepingcomputer.com", "thehackernews.com", "openai.com", "anthropic.com", "blog.google",
        "blogs.microsoft.com", "aws.amazon.com", "cloud.google.com", "meta.ai",
    ),
    "tech_article": (
        "lobste.rs", "stackoverflow.com", "juejin.cn", "segmentfault.com", "csdn.net", "blog.csdn.net", "zhihu.com", "v2ex.com", "ruanyifeng.com",
        "martinfowler.com", "medium.com", "towardsdatascience.com", "freecodecamp.org", "baeldung.com", "digginginto.dev", "iximiuz.com", "mysql.com",
        "redis.io", "postgresql.org", "docs.spring.io", "kubernetes.io",
    ),
}
CATEGORY_TITLES = (
    (r"(?:论文|(?:paper|arxiv)\b)", "paper"),
    (r"(?:开源|open[- ]?source)\s*(?:项目|库|工具|release|发布)", "open_source"),
    (r"(?:github\s+(?:trending|starred|release)|awesome\s+\w+|(?:npm|pypi|cargo)\s+(?:publish|release))", "open_source"),
    (r"(?:release[d]?|发布|launch|新版本|新功能)\b.*?(?:v?\d+\.\d+)", "open_source"),
    (
        r"(?:\b(?:llm|gpt|claude|gemini|qwen|sora|ai\s*agent|rag|embedding|transformer|diffusion|multimodal|agi|o1|o3|o4|deepseek|qwen2|mistral|llama)\b|大\s*模型|语言模型|深度学习|机器学习|神经网络)",
        "hot_trend",
    ),
    (r"(?:工具推荐|开发工具|(?:devtool|插件|extension|vscode|编辑器|ide|终端|shell|docker|k8s|kubernetes)\b)", "dev_tool"),
    (r"(?:教程|指南|(?:best\s*practice)\b|入门|进阶|原理分析|源码解析|实战|踩坑|避坑)", "tech_article"),
    (r"(?:创意|有趣\s*(?:项目|工具|实验|应用|想法|发现|库)|(?:hackathon)\b)", "creative"),
)
DEFAULT_CATEGORY, UNKNOWN_SOURCE = "tech_article", "未知来源"

# Names of sources by domain or domain suffix, in order.
SOURCE_NAMES = {
    "docs.spring.io": "Spring", "spring.io": "Spring", "docs.python.org": "Python", "python.org": "Python", "developer.mozilla.org": "MDN",
    "kubernetes.io": "Kubernetes", "istio.io": "Istio", "react.dev": "React", "vuejs.org": "Vue.js", "docs.github.com": "GitHub Docs", "github.blog": "GitHub Blog",
    "aws.amazon.com": "AWS", "cloud.google.com": "Google Cloud", "azure.microsoft.com": "Azure", "docs.oracle.com": "Oracle", "dev.mysql.com": "MySQL",
    "postgresql.org": "PostgreSQL", "redis.io": "Redis", "mongodb.com": "MongoDB", "openai.com": "OpenAI", "anthropic.com": "Anthropic",
    "huggingface.co": "Hugging Face", "news.ycombinator.com": "Hacker News", "stackoverflow.com": "Stack Overflow", "infoq.com": "InfoQ", "infoq.cn": "InfoQ中文",
    "juejin.cn": "掘金", "segmentfault.com": "思否", "csdn.net": "CSDN", "blog.csdn.net": "CSDN", "zhihu.com": "知乎", "v2ex.com": "V2EX", "lobste.rs": "Lobsters",
    "reddit.com": "Reddit", "producthunt.com": "Product Hunt", "techcrunch.com": "TechCrunch", "theverge.com": "The Verge", "arstechnica.com": "Ars Technica",
    "medium.com": "Medium", "dev.to": "DEV Community", "freecodecamp.org": "freeCodeCamp", "baeldung.com": "Baeldung", "martinfowler.com": "Martin Fowler",
    "ruanyifeng.com": "阮一峰", "github.com": "GitHub", "gitlab.com": "GitLab", "gitee.com": "Gitee", "npmjs.com": "npm", "pypi.org": "PyPI",
    "crates.io": "crates.io", "pkg.go.dev": "Go Packages", "deno.land": "Deno", "bun.sh": "Bun", "rust-lang.org": "Rust", "nodejs.org": "Node.js",
    "arxiv.org": "arXiv", "paperswithcode.com": "Papers With Code", "scholar.google.com": "Google Scholar", "jetbrains.com": "JetBrains",
    "code.visualstudio.com": "VS Code", "docker.com": "Docker", "postman.com": "Postman", "figma.com": "Figma", "vercel.com": "Vercel", "vercel.app": "Vercel",
    "netlify.app": "Netlify", "36kr.com": "36氪", "ithome.com": "IT之家", "sspai.com": "少数派", "thenewstack.io": "The New Stack",
}

# Lines that are boilerplate wherever they stand.
BOILERPLATE = (
    r"(?i)^.*\b(we use cookies|accept cookies|cookie policy|privacy policy|cookie consent|this site uses cookies|consent preferences)\b.*$",
    r"(?i)^.*\b(subscribe to|newsletter|sign up for|email updates|join our mailing|get notified|never miss a post)\b.*$",
    r"(?i)^.*\b(share on|share this|follow us on|tweet this|pin this|share this post|share this article)\b.*$",
    r"(?i)^.*\b(copyright\s+\d{4}|all rights reserved|\(c\)|©)\b.*$",
    r"(?i)^.*\b(page \d+ of \d+|previous page|next page|pagination|load more|show more)\b.*$",
    r"^.*(ICP备\d+号|ICP证\d+|备案号|公安备案|公网安备\d+号|网站备案).*$",
    r"^.*(扫码关注|关注公众号|关注.*公众号|领取.*代金券|微信扫码|添加微信|扫描二维码).*$",
    r"^.*(请登录后发表评论|登录后即可评论|登录.*评论|您还未登录|请先登录|登录后才能).*$",
    r"^.*(本文参与.*同步曝光计划|同步曝光|曝光计划|参与.*社区激励).*$",
    r"^.*(编辑精选|精选文章|推荐阅读|相关文章|热门推荐|相关推荐|猜你喜欢|为你推荐).*$",
    r"^.*(AI生成内容|本文由AI辅助生成|AI辅助创作|由AI生成|本文使用AI|内容由AI|AI技术生成).*$",
    r"^.*(版权声明：本文为博主原创|CSDN博客|分类专栏|文章目录|展开全部|收起).*$",
    r"^.*(本文转载自|版权声明：本文|文章来源|原文链接|转载.*注明出处|著作权归作者所有|来源：).*$",
    r"^.*(举报反馈|意见反馈|投诉举报|侵权投诉|举报.*电话|反馈建议|我要反馈).*$",
    r"^.*(本文仅代表作者观点|不代表.*立场|免责声明|风险提示|投资有风险).*$",
    r"^.*(打赏作者|赏金|赞赏|投币|一键三连|求关注|给作者点赞|您的支持是我).*$",
    r"^.*(阅读[\s\d]+(次)?.*(点赞|收藏|评论|分享)[\s\d]+|点赞[\s\d]+.*阅读[\s\d]+|收藏[\s\d]+.*分享[\s\d]+).*$",
    r"^.*(限时优惠|点击购买|立即下单|免费试用|优惠券|折扣码|推广链接|赞助内容|广告合作|扫码领取|限量.*抢购|不容错过).*$",
    r"^.*(下载APP|打开APP|APP内打开|APP内阅读|使用APP|下载客户端).*$",
    r"^.*(点击查看原文|点击阅读原文|查看完整版|阅读完整版|查看原文链接|请阅读原文|去查看原文|查看全文).*$",
    r"^.*(解锁全文|展开剩余|点击展开全文|查看完整内容|购买继续阅读|本文需要付费|订阅后查看|开通会员.*阅读|剩余.*内容.*登录).*$",
    r"^.*(热门活动.*报名|参与活动.*赢|推荐课程.*元|精品课程.*折|课程推荐.*限时|近期活动.*报名|热门活动|活动推荐).*$",
    r"^.*(开通VIP|升级VIP|会员专享|VIP特权|VIP免费|超级会员|年费会员|月度会员).*$",
    r"^.*(长按识别|扫码入群|扫码下载|扫码关注|二维码入群|加入.*技术交流群|加入.*QQ群|加入.*微信群|扫码加群).*$",
    r"^.*(我们使用Cookie|本站使用Cookie|隐私偏好|Cookie设置|Cookie偏好|接受所有Cookie).*$",
)

# Words that titles are compared without.
TITLE_STOPWORDS = tuple(
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 the a an is are was were be been being have has had do does did will would could "
    "should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once".split()
)
POSITIVE_WORDS = ("推荐", "最佳", "优秀", "优点", "亮点", "best", "great", "awesome", "recommended")
NEGATIVE_WORDS = ("缺点", "问题", "踩坑", "避坑", "风险", "限制", "downside", "issue", "problem", "limitation")
# Names of answer categories by alias, and those that are allowed.
CATEGORY_ALIASES = {
    "backend": "后端开发", "frontend": "前端开发", "mobile": "移动开发", "database": "数据库", "devops": "DevOps", "cloud": "云计算", "ai": "AI与机器学习", "ai/ml": "AI与机器学习",
    "machine learning": "AI与机器学习", "security": "安全", "blockchain": "区块链", "other": "其他",
}
ALLOWED_CATEGORIES = ("后端开发", "前端开发", "移动开发", "数据库", "DevOps", "云计算", "AI与机器学习", "安全", "区块链", "其他")
# Weights of the coverage score.
COVERAGE_WEIGHTS = {"angle": 0.25, "diversity": 0.20, "depth": 0.15, "temporal": 0.15, "perspective": 0.15, "language": 0.10}

# Strategies: thresholds below which a dimension is worked on, wider time ranges, kinds of strategy, directions, and words added to a keyword.
STRATEGY_THRESHOLDS = {"diversity": 0.6, "perspective": 0.6, "language": 0.3, "depth": 0.6, "angle": 0.6, "temporal": 0.6}
WIDER_RANGES = {"day": "week", "week": "month", "month": "year", "year": "all"}
DEPTH_DIMENSIONS, BREADTH_DIMENSIONS = ("depth", "angle", "temporal"), ("diversity", "perspective", "language")
# Words added to a keyword, the usual ones and then those of second choice; for keywords with ideographs, and for all others.
STRATEGY_SUFFIXES_CN = {
    "depth": ("原理 源码分析", "内部实现 实战", "深入理解 底层原理", "源码解读 实现细节", "架构设计 思路", "核心概念 详解", "实现原理 分析", "技术选型 方案"),
    "angle": ("对比 评测", "最佳实践", "性能优化", "常见问题 解决方案", "使用场景 案例", "进阶技巧 高级用法", "替代方案 迁移", "趋势 发展方向"),
    "perspective": ("缺点 限制", "问题 风险", "踩坑 避坑"),
}
STRATEGY_SUFFIXES_EN = {
    "depth": (
        "architecture deep dive", "internals implementation", "how it works under the hood", "in-depth tutorial", "architecture design patterns", "core concepts explained",
        "implementation analysis", "technology selection",
    ),
    "angle": (
        "comparison vs alternatives", "best practices", "performance optimization", "common issues troubleshooting", "use cases examples", "advanced techniques",
        "alternatives migration", "trends roadmap",
    ),
    "perspective": ("downsides limitations", "problems risks", "pitfalls lessons learned"),
}
STRATEGY_SITES_CN = ("github.com", "juejin.cn", "zhihu.com", "segmentfault.com", "infoq.cn")
STRATEGY_SITES_EN = ("github.com", "medium.com", "dev.to", "stackoverflow.com", "news.ycombinator.com")
LATEST_CN, LATEST_EN = "最新", "latest"
SEARCH_ENGINES = ("bing", "baidu", "sogou", "google")

# Where result pages of each engine hold their items, and within an item the title, link and snippet; fallbacks are tried in order (fixed values).
SERP_SELECTORS = {
    "sogou": {"item": ".vrwrap", "title": ".vrTitle a, h3 a", "link": ".vrTitle a, h3 a", "snippet": ".str-text, .star-w", "fallbacks": (".results .rb", ".result")},
    "bing": {"item": "li.b_algo", "title": "h2 a", "link": "h2 a", "snippet": "p.b_lineclamp2, p.b_caption, .b_caption p, p", "fallbacks": ("#b_results li", "ol#b_results > li")},
    "baidu": {"item": ".result.c-container", "title": "h3 a", "link": "h3 a", "snippet": ".c-abstract, .content-right", "fallbacks": (".c-container", ".result")},
    "google": {"item": "div.tF2Cxc", "title": "h3", "link": "div.yuRUbf a", "snippet": ".VwiC3b, .s3v94d, span.aCOpRe", "fallbacks": ("div[data-sokoban-container]", "div.g")},
}
# What a search address adds for a time range (fixed values); the fourth engine takes a window of seconds instead.
SERP_TIMES = {
    "bing": {"day": '&filters=ex1:"ez5_4251_4252"', "week": '&filters=ex1:"ez5_4251_4253"', "month": '&filters=ex1:"ez5_4251_4254"', "year": '&filters=ex1:"ez5_4251_4255"', "all": ""},
    "google": {"day": "&tbs=qdr:d", "week": "&tbs=qdr:w", "month": "&tbs=qdr:m", "year": "&tbs=qdr:y", "all": ""},
    "sogou": {"day": "&intime=1", "week": "&intime=7", "month": "&intime=30", "year": "&intime=365", "all": ""},
}
