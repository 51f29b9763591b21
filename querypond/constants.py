"""Rule tables. All values here are fixed: results depend on them, and they must equal the established ones."""

from __future__ import annotations

# Hosts and their trust, 0 to 100.
TRUST_HOSTS: dict[int, list[str]] = {
    100: [
        "docs.python.org", "docs.rust-lang.org", "doc.rust-lang.org", "docs.oracle.com", "docs.swift.org", "docs.djangoproject.com", "docs.spring.io", "docs.nestjs.com",
        "docs.astro.build", "nuxt.com", "nextjs.org", "react.dev", "vuejs.org", "angular.dev", "svelte.dev", "kit.svelte.dev", "solidjs.com", "remix.run", "laravel.com",
        "rubyonrails.org", "go.dev", "kotlinlang.org", "typescriptlang.org", "nodejs.org", "deno.land", "bun.sh", "webpack.js.org", "vitejs.dev", "esbuild.github.io",
        "rollupjs.org", "jestjs.io", "vitest.dev", "playwright.dev", "docs.docker.com", "kubernetes.io", "terraform.io", "docs.aws.amazon.com", "cloud.google.com", "pytorch.org",
        "tensorflow.org",
    ],
    99: [
        "developer.mozilla.org",
    ],
    98: [
        "learn.microsoft.com", "rfc-editor.org", "datatracker.ietf.org",
    ],
    96: [
        "github.com",
    ],
    95: [
        "arxiv.org", "openai.com",
    ],
    90: [
        "platform.openai.com", "docs.anthropic.com", "aws.amazon.com", "w3.org", "whatwg.org", "ietf.org",
    ],
    85: [
        "paperswithcode.com", "lilianweng.github.io", "console.aws.amazon.com", "azure.microsoft.com", "docs.vercel.com", "npmjs.com", "pypi.org", "crates.io", "ieee.org",
        "acm.org", "jmlr.org", "proceedings.mlr.press",
    ],
    80: [
        "overreacted.io", "kentcdodds.com", "addyosmani.com", "2ality.com", "jakearchibald.com", "web.dev", "css-tricks.com", "smashingmagazine.com", "martinfowler.com",
        "blog.jbrains.ca", "increment.com", "changelog.com", "thenewstack.io", "blog.rust-lang.org", "blog.golang.org", "v8.dev", "webkit.org", "hacks.mozilla.org",
        "engineering.atspotify.com", "netflixtechblog.com", "engineering.fb.com", "research.google", "huggingface.co", "jax.readthedocs.io", "mlflow.org", "wandb.ai",
        "docs.cohere.com", "github.blog", "simonwillison.net", "stability.ai", "replicate.com", "langchain.com", "python.langchain.com", "js.langchain.com", "llamaindex.ai",
        "docs.llamaindex.ai", "firebase.google.com", "docs.supabase.com", "vercel.com", "rubygems.org", "nuget.org", "springer.com", "link.springer.com", "sciencedirect.com",
        "nature.com",
    ],
    75: [
        "learnprompting.org", "promptingguide.ai", "blog.langchain.dev", "digitalocean.com", "linode.com", "planetscale.com", "neon.tech", "netlify.com", "fly.io",
        "packagist.org", "circleci.com", "githubactions.com", "plos.org", "openreview.net",
    ],
    70: [
        "dev.to", "towardsdatascience.com", "railway.app", "render.com", "codecov.io", "sonarcloud.io",
    ],
    65: [
        "betterprogramming.pub",
    ],
    60: [
        "medium.com", "levelup.gitconnected.com",
    ],
}
HIGH_AUTHORITY = [
    "docs.python.org", "docs.rust-lang.org", "doc.rust-lang.org", "docs.oracle.com", "docs.swift.org", "docs.djangoproject.com", "docs.spring.io", "docs.nestjs.com",
    "docs.astro.build", "nuxt.com", "nextjs.org", "react.dev", "vuejs.org", "angular.dev", "svelte.dev", "kit.svelte.dev", "solidjs.com", "remix.run", "laravel.com",
    "rubyonrails.org", "go.dev", "kotlinlang.org", "typescriptlang.org", "nodejs.org", "deno.land", "bun.sh", "webpack.js.org", "vitejs.dev", "esbuild.github.io", "rollupjs.org",
    "jestjs.io", "vitest.dev", "playwright.dev", "docs.docker.com", "kubernetes.io", "terraform.io", "docs.aws.amazon.com", "cloud.google.com", "learn.microsoft.com",
    "pytorch.org", "tensorflow.org", "developer.mozilla.org", "rfc-editor.org", "datatracker.ietf.org", "github.com", "openai.com", "platform.openai.com", "docs.anthropic.com",
    "huggingface.co", "arxiv.org", "paperswithcode.com", "langchain.com", "python.langchain.com", "llamaindex.ai", "lilianweng.github.io", "openreview.net", "w3.org",
    "whatwg.org", "ietf.org", "stackoverflow.com", "stackoverflow.co", "ieee.org", "acm.org", "spring.io", "hibernate.org", "apache.org", "elastic.co", "redis.io", "mongodb.com",
    "postgresql.org", "sqlite.org", "prisma.io", "tailwindcss.com", "getbootstrap.com", "npmjs.com", "pypi.org", "crates.io", "aws.amazon.com", "azure.microsoft.com",
    "supabase.com", "vercel.com", "neon.tech", "jmlr.org", "proceedings.mlr.press", "opencode.ai",
]

CREDIBLE = [".edu", ".gov", ".mil", "wikipedia.org", "arxiv.org", "github.com", "stackoverflow.com", "stackexchange.com", "developer.mozilla.org", "scholar.google.com", "semanticscholar.org", "pubmed.ncbi.nlm.nih.gov", "ieee.org", "acm.org", "nature.com", "science.org", "springer.com"]
DOUBTFUL = ["medium.com", "dev.to", "vocal.media", "quora.com", "hubpages.com", "wikihow.com", "buzzfeed.com", "dailymail.co.uk"]
CREDIBLE_PROVIDERS = ["arxiv", "semanticscholar", "pubmed", "github", "mdn"]

PROVIDER_QUALITY = {"arxiv": 0.95, "semanticscholar": 0.95, "pubmed": 0.95, "crossref": 0.85, "github": 0.80, "mdn": 0.75, "wikipedia": 0.70, "googlenews": 0.60, "hackernews": 0.55, "twitter": 0.45, "stackexchange": 0.50, "reddit": 0.40, "devto": 0.35, "medium": 0.30, "brave": 0.45, "duckduckgo": 0.45}
URL_QUALITY = [
    (r"\.(edu|ac\.uk|ac\.jp|ac\.kr|ac\.cn|ac\.in|edu\.au)/", 0.90), (r"/doi\.org/", 0.85), (r"/papers?\.[a-z]+/", 0.80), (r"/proceedings/", 0.80), (r"/docs\.", 0.75), (r"/learn/", 0.70), (r"/tutorials?/", 0.65),
    (r"^https?://github\.com/[\w.-]+/[\w.-]+$", 0.80), (r"\.(reuters|bloomberg|bbc|cnn|nytimes|theguardian|washingtonpost)\.com", 0.65), (r"/?(best|top|most)\s*\d+\s", 0.20), (r"\d+\s*(best|top|reasons|ways|tips|tricks|hacks)\s", 0.15), (r"(vocal|medium)\.com", 0.25),
]
LISTICLE = r"/(best|top|most)[\s-]?\d+|\d+[\s-]?(best|top|reason|way|tip|trick)"

CODE_HOSTS = [
    (r"^https?://(www\.)?github\.com/", 0.9), (r"^https?://(www\.)?gitlab\.com/", 0.85), (r"^https?://(www\.)?bitbucket\.org/", 0.8), (r"^https?://(www\.)?npmjs\.com/", 0.85), (r"^https?://(www\.)?pypi\.org/", 0.8), (r"^https?://crates\.io/", 0.85), (r"^https?://docs\.rs/", 0.9), (r"^https?://deno\.land/", 0.8),
    (r"^https?://unpkg\.com/", 0.75), (r"^https?://cdn\.jsdelivr\.net/", 0.75), (r"^https?://stackblitz\.com/", 0.7), (r"^https?://codesandbox\.io/", 0.7), (r"^https?://replit\.com/", 0.7), (r"^https?://codepen\.io/", 0.7), (r"^https?://(www\.)?sourceforge\.net/", 0.65),
]
CODE_INDICATORS = [
    r"\b(typescript|javascript|python|rust|go|java|c\+\+|ruby)\b", r"\b(git|commit|branch|merge|pr|pull.request)\b", r"\b(api|sdk|library|framework|module|package|dependency)\b", r"\b(install|npm install|pip install|cargo install|go get)\b", r"\b(function|class|interface|type|import|export|const|let|var)\b",
]
EXAMPLE_INDICATORS = r"\b(example|tutorial|guide|how.to|demo|sample|recipe|quickstart|getting.started|walkthrough|cookbook|playground|sandbox)\b"

CLICKBAIT = ["you won't believe", "you will not believe", "mind blowing", "mind-blowing", "top 10", "top 5", "top 3", "number one", "shocking", "jaw dropping", "jaw-dropping", "life changing", "life-changing", "secret revealed", "doctors hate", "one weird trick", "click here", "don't miss", "do not miss", "limited time", "act now", "free money", "make money fast", "get rich", "lose weight fast"]
STUFFING_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "it", "its", "this", "that", "as", "if", "not", "so", "we", "you", "he", "she", "they", "i", "my", "your", "our", "their", "can", "will", "would", "could", "should",
]
CONCEPT_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "it", "its", "this", "that", "as", "if", "not", "so", "we", "you", "he", "she", "they", "i", "my", "your", "our", "their", "can", "will", "would", "could", "should",
    "what", "which", "who", "whom", "how", "where", "when", "why", "want", "need", "get", "make", "use", "build", "create", "find", "best", "good", "great", "top", "new",
    "latest", "all", "some", "any", "about", "into", "over", "up", "out", "off", "down", "just", "also", "very", "too", "much", "more", "most", "many", "such", "than", "then",
    "now", "here", "there", "only", "really", "actually", "still", "even", "well", "back", "being", "done", "going", "know", "take", "see", "like", "look", "way", "thing",
    "things", "something", "everything", "nothing", "someone", "everyone", "anyone", "anything",
]
TOPIC_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "it", "its", "this", "that", "what", "which", "who", "how", "where", "when", "why", "want", "need", "get", "make", "use", "build", "can", "will", "would", "should",
    "could", "about", "into", "over", "up", "out", "just", "also", "very", "too", "much", "many", "some", "any", "all", "more", "most", "not", "no", "yes", "like", "well", "back",
    "going", "looking",
]
OFF_TOPIC_SOURCES = {"mdn": ["agent", "autonomous", "research", "paper", "LLM", "benchmark"], "devto": ["research", "paper", "arxiv", "LLM benchmark"]}

# First match decides. Only the first is case-sensitive.
INTENT_RULES = [
    ("research", r"\b(ReAct|Reflexion|CodeAct)\b"), ("programming", r"\b(typescript|javascript|ecmascript|js|ts|jsx|tsx)\b"), ("programming", r"\b(python|rust|golang|java|ruby|php|swift|kotlin|scala|perl|haskell|elixir|clojure|dart|lua)\b"), ("programming", r"\b(c#|c\+\+)"),
    ("programming", r"\b(react|vue|angular|svelte|nextjs|nuxt|remix|solidjs|qwik)\b"), ("programming", r"\b(django|spring|laravel|flask|fastapi|express|nestjs|rails|dotnet)\b"), ("programming", r"\b(docker|kubernetes|devops|ci/cd|terraform|ansible)\b"), ("programming", r"\b(generics|function|class|interface|type|variable|syntax|compile|runtime)\b"),
    ("programming", r"\b(best practices|code|programming|coding|software development|web dev)\b"), ("programming", r"\b(api|endpoint|sdk|framework|library|module|package|npm|pip|cargo|nuget)\b"), ("package", r"\b(npm|pypi|package|install|dependency)\b"), ("github", r"\bgithub\b|\brepo(sitory)?\b"),
    ("security", r"\b(vulnerab|cve|exploit|xss|csrf|injection|security)\b"), ("debugging", r"\b(error|exception|stack trace|bug|fix|not working|crash)\b"), ("research", r"\b(SWE.?agent|OpenHands|OpenDevin|AutoGPT|CrewAI|LangGraph|MetaGPT)\b"), ("research", r"\b(memory.*tool.*planning.*execution.*self.?correction)\b"),
    ("research", r"\b(best.*open.?source.*project.*paper|open.?source.*project.*agent)\b"), ("research", r"\b(repository.?level.*code.*gen|autonomous.*coding.*agent)\b"), ("academic", r"\b(paper|arxiv|study|research paper|citation|state.?of.?the.?art)\b"), ("research", r"\b(LLM.*benchmark|agent.*benchmark|SOTA.*LLM|survey.*LLM)\b"),
    ("news", r"\b(news|announc|release[ds]?|latest)\b"), ("comparison", r"\bvs\.?\b|\bversus\b|\bcompare[ds]?\b|\bwhich is better\b"), ("tutorial", r"\bhow to\b|\btutorial\b|\bguide\b|\bwalkthrough\b"), ("architecture", r"\barchitecture\b|\bdesign pattern\b|\bsystem design\b"), ("documentation", r"\bdocs?\b|\bdocumentation\b"),
]
NEWS_CLASSES = {
    "cybersecurity": [r"\b(breach|breached|breaches)\b", r"\b(exploit|exploits|exploited|exploitation)\b", r"\b(vulnerab|vulnerability|vulnerabilities)\b", r"\b(malware|ransomware|spyware|trojan|virus|worm)\b", r"\b(CVE-\d+|zero.day|0day)\b", r"\b(hacker|hackers|hacking|hacked|hack)\b", r"\b(cyber|cybersecurity|cyber.attack|cybercrime|cyber.war)\b", r"\b(data.leak|data.breach|data.exfiltrat)\b", r"\b(phishing|social.engineering|DDoS|botnet)\b", r"\b(pen.test|penetration.test|red.team|blue.team|security.research)\b"],
    "technology": [r"\b(AI|artificial.intelligence|machine.learning|deep.learning)\b", r"\b(startup|start.up|funding|series.[ABCDE]|venture.capital)\b", r"\b(launch|launched|product.launch|new.release)\b", r"\b(software|hardware|chip|semiconductor|processor|GPU|CPU)\b", r"\b(robot|automation|autonomous|self.driving)\b", r"\b(blockchain|crypto|bitcoin|ethereum|NFT)\b", r"\b(cloud|SaaS|PaaS|IaaS|infrastructure|platform)\b"],
    "business": [r"\b(stock|stock.market|share|shares|trading|investor)\b", r"\b(market|economy|economic|inflation|recession|GDP)\b", r"\b(finance|financial|bank|banking|interest.rate|Fed)\b", r"\b(IPO|acquisition|merger|mergers|M&A|takeover)\b", r"\b(earnings|revenue|profit|quarterly|fiscal)\b", r"\b(CEO|CFO|executive|management|leadership|corporate)\b"],
    "science": [r"\b(research|study|studies|scientist|scientists|researcher)\b", r"\b(discover|discovery|breakthrough|findings)\b", r"\b(NASA|space|astronomy|telescope|planet|galaxy|mars)\b", r"\b(medical|medicine|drug|clinical.trial|FDA|treatment)\b", r"\b(climate|climate.change|global.warming|environment|ecosystem)\b", r"\b(physics|chemistry|biology|genetic|genome|dna|evolution)\b"],
    "politics": [r"\b(election|vote|voting|campaign|president|congress|senate)\b", r"\b(government|policy|legislation|regulation|law|legal)\b", r"\b(democrat|republican|bipartisan|senator|representative)\b", r"\b(foreign.policy|diplomacy|sanction|treaty|summit)\b", r"\b(supreme.court|justice|judge|ruling|constitutional)\b"],
    "entertainment": [r"\b(movie|film|cinema|actor|actress|director|Hollywood)\b", r"\b(music|album|song|concert|band|singer|musician)\b", r"\b(game|gaming|video.game|console|playstation|xbox|nintendo)\b", r"\b(celebrity|famous|star|tabloid|gossip)\b", r"\b(TV|television|series|episode|streaming|Netflix|Disney)\b"],
    "health": [r"\b(health|healthcare|medical|hospital|clinic|patient)\b", r"\b(disease|outbreak|epidemic|pandemic|virus|covid|vaccine)\b", r"\b(FDA|CDC|WHO|approval|drug|medicine|treatment|therapy)\b", r"\b(mental.health|depression|anxiety|wellness|nutrition)\b", r"\b(cancer|diabetes|heart|stroke|alzheimer|dementia)\b"],
}
SCRIPTS = [("ar", r"[؀-ۿݐ-ݿ]"), ("zh", r"[一-鿿]"), ("ja", r"[぀-ヿ]"), ("ru", r"[Ѐ-ӿ]"), ("ko", r"[가-힯]")]
LATIN_HINTS = [("fr", r"\b(le|la|les|des|est|une|pour|avec|comment)\b"), ("es", r"\b(el|la|los|las|es|una|para|con|como|qué)\b"), ("de", r"\b(der|die|das|und|ist|eine|für|mit|wie)\b")]
ENTITY_DOMAINS = [
    ("ai_coding_agent", [r"\b(autonomous\s*(coding|software|code)\s*agent)\b", r"\b(AI\s*(coding|software|code)\s*agent)\b", r"\b(LLM\s*agent|language\s*model\s*agent)\b", r"\b(SWE.?agent|OpenHands|OpenDevin|AutoGPT|CrewAI|LangGraph|MetaGPT|Devin)\b", r"\b(coding\s*agent|code\s*agent|software\s*agent)\b", r"\b(memory\s*(tools?|management|system).*planning.*execution)\b", r"\b(self.?correction|self.?reflect|reflexion)\b", r"\b(repository.?level\s*code\s*gen)\b"], ["arxiv", "semanticscholar", "github"], ["mdn", "wikipedia", "devto"]),
    ("cybersecurity_competition", [r"\b(cybersecurity|cyber\s*security)\s*(competition|challenge|contest|CTF)\b", r"\b(CTF|capture\s*the\s*flag)\b", r"\b(hacking\s*competition|hackathon.*security)\b", r"\b(DEF\s*CON|defcon)\b", r"\b(cyber\s*challenge|national\s*cyber\s*league)\b"], ["googlenews", "twitter", "hackernews", "stackexchange"], ["wikipedia"]),
    ("llm_research_paper", [r"\b(LLM|large\s*language\s*model)\s*(paper|research|survey|benchmark)\b", r"\b(state.?of.?the.?art|SOTA)\s*(LLM|language\s*model)\b", r"\b(best\s*(open.?source|OSS)\s*(LLM|model|project))\b"], ["semanticscholar", "arxiv", "pubmed", "github"], ["mdn", "devto"]),
]
INTENT_SOURCES = {
    "programming": ["github", "stackexchange", "mdn", "devto", "medium"],
    "package": ["npm", "pypi", "github", "brave"],
    "github": ["github", "brave"],
    "security": ["github", "stackexchange", "hackernews", "mdn"],
    "debugging": ["stackexchange", "github", "hackernews", "medium"],
    "api": ["mdn", "github", "stackexchange", "brave"],
    "academic": ["semanticscholar", "pubmed", "arxiv", "crossref", "wikipedia"],
    "news": ["googlenews", "hackernews", "twitter", "reddit", "brave", "medium", "wikipedia", "stackexchange"],
    "documentation": ["mdn", "github", "wikipedia", "devto"],
    "comparison": ["hackernews", "reddit", "stackexchange", "twitter", "wikipedia", "brave"],
    "tutorial": ["mdn", "devto", "stackexchange", "github", "youtube", "medium"],
    "reference": ["wikipedia", "mdn", "github", "brave", "duckduckgo"],
    "architecture": ["github", "hackernews", "medium", "wikipedia"],
    "research": ["semanticscholar", "pubmed", "arxiv", "crossref", "github", "hackernews", "brave"],
    "general": ["brave", "duckduckgo", "wikipedia", "hackernews", "reddit", "stackexchange"],
}
KEYWORD_SOURCES = [
    ("youtube", ["youtube"]),
    ("video", ["youtube"]),
    ("tutorial", ["youtube", "devto", "medium"]),
    ("reddit", ["reddit"]),
    ("github", ["github"]),
    ("npm", ["npm"]),
    ("pypi", ["pypi"]),
    ("arxiv", ["arxiv"]),
    ("paper", ["arxiv", "semanticscholar"]),
    ("research", ["semanticscholar", "pubmed", "arxiv"]),
]
KEYWORD_BOOSTS = [("youtube", "youtube"), ("video", "youtube"), ("tutorial", "youtube"), ("reddit", "reddit"), ("github", "github"), ("npm", "npm"), ("pypi", "pypi"), ("arxiv", "arxiv")]
# id, priority, most results, category
SOURCES = [
    ("brave", 9, 20, "web"), ("mdn", 9, 20, "docs"), ("arxiv", 9, 20, "academic"), ("crossref", 9, 20, "academic"), ("github", 8, 20, "code"), ("semanticscholar", 8, 20, "academic"), ("pubmed", 8, 20, "academic"), ("npm", 8, 20, "package"), ("pypi", 8, 20, "package"), ("duckduckgo", 7, 20, "web"), ("stackexchange", 7, 20, "qa"), ("googlenews", 7, 20, "news"), ("wikipedia", 7, 20, "reference"),
    ("devto", 6, 20, "blog"), ("youtube", 6, 20, "video"), ("hackernews", 5, 20, "community"), ("reddit", 5, 25, "community"), ("medium", 5, 20, "blog"), ("twitter", 5, 10, "social"), ("gdelt", 4, 20, "news"), ("cve", 4, 15, "security"), ("osv", 4, 15, "security"), ("wikidata", 4, 20, "reference"), ("commoncrawl", 3, 10, "web"), ("internetarchive", 3, 15, "archive"), ("rss", 3, 15, "news"),
]
TECHNOLOGIES = ["react", "next.js", "nextjs", "node.js", "nodejs", "typescript", "javascript", "python", "fastify", "express", "django", "flask", "docker", "kubernetes", "rust", "go", "vue", "angular", "svelte", "graphql", "postgresql", "postgres", "redis", "mongodb", "prisma", "tailwind", "webpack", "vite", "deno", "bun", "java", "kotlin", "swift", "terraform", "linux", "aws", "gcp", "azure"]
TECHNOLOGY_DOMAINS = {
    "react": ["react.dev", "github.com/facebook/react"], "nextjs": ["nextjs.org", "github.com/vercel/next.js"], "vue": ["vuejs.org", "github.com/vuejs/core"], "angular": ["angular.dev", "github.com/angular/angular"], "svelte": ["svelte.dev", "github.com/sveltejs/svelte"], "nodejs": ["nodejs.org", "github.com/nodejs/node"], "deno": ["deno.com", "github.com/denoland/deno"], "bun": ["bun.sh", "github.com/oven-sh/bun"], "fastify": ["fastify.dev", "github.com/fastify/fastify"],
    "express": ["expressjs.com", "github.com/expressjs/express"], "typescript": ["typescriptlang.org", "github.com/microsoft/TypeScript"], "python": ["docs.python.org", "github.com/python/cpython"], "django": ["docs.djangoproject.com", "github.com/django/django"], "flask": ["flask.palletsprojects.com", "github.com/pallets/flask"], "rust": ["doc.rust-lang.org", "github.com/rust-lang/rust"], "go": ["go.dev", "github.com/golang/go"], "java": ["docs.oracle.com/en/java", "github.com/openjdk/jdk"],
    "kotlin": ["kotlinlang.org", "github.com/JetBrains/kotlin"], "swift": ["swift.org", "github.com/apple/swift"], "docker": ["docs.docker.com", "github.com/docker/cli"], "kubernetes": ["kubernetes.io", "github.com/kubernetes/kubernetes"], "terraform": ["developer.hashicorp.com/terraform", "github.com/hashicorp/terraform"], "postgres": ["postgresql.org", "github.com/postgres/postgres"], "postgresql": ["postgresql.org", "github.com/postgres/postgres"], "redis": ["redis.io", "github.com/redis/redis"],
    "mongodb": ["mongodb.com/docs", "github.com/mongodb/mongo"], "graphql": ["graphql.org", "github.com/graphql/graphql-spec"], "prisma": ["prisma.io", "github.com/prisma/prisma"], "vite": ["vitejs.dev", "github.com/vitejs/vite"], "webpack": ["webpack.js.org", "github.com/webpack/webpack"], "tailwind": ["tailwindcss.com", "github.com/tailwindlabs/tailwindcss"], "linux": ["kernel.org", "man7.org/linux/man-pages"], "aws": ["docs.aws.amazon.com", "github.com/aws/aws-sdk-js"],
    "gcp": ["cloud.google.com/docs", "github.com/googleapis/google-cloud-node"], "azure": ["learn.microsoft.com/azure", "github.com/Azure/azure-sdk-for-js"],
}
HEDGING = [r"\bdo(?:es)? not provide\b", r"\bdoes not offer\b", r"\bno clear\b", r"\bnot clear\b", r"\bnot explicitly\b", r"\blimited information\b", r"\bunable to determine\b", r"\bcannot determine\b", r"\binsufficient\b", r"\bno direct\b", r"\bnot directly\b", r"\bdoes not contain\b", r"\bno evidence\b", r"\bdid not find\b", r"\bcould not find\b", r"\bnot enough\b", r"\bno relevant\b", r"\bis not mentioned\b", r"\bare not mentioned\b", r"\bsources do not\b", r"\bno information\b", r"\bdoes not address\b", r"\bno concrete\b", r"\bdoes not specif(y|ied)\b"]
AI_TARGETED = [r"\b(?:instructions?\s+for\s+(?:AI|LLM|autonomous|language\s+model)s?)\b", r"\b(?:optimized\s+for\s+(?:AI|LLM|language\s+model)s?)\b", r"\b(?:designed\s+for\s+(?:AI|LLM|autonomous)\s+agents)\b", r"\b(?:skill\s+documentation\s+for\s+(?:AI|LLM) agents)\b", r"\b(?:context\s+(?:window|length|injection)\s+(?:for|of)\s+(?:AI|LLM))\b", r"\b(?:prompt\s+(?:injection|engineering|design)\s+guide)\b", r"\b(?:LLM\s+(?:skills?|knowledge|training|dataset))\b"]
CODE_LANGUAGES = {
    "rust": [r"\bfn\s+\w+", r"\blet\s+mut\b", r"println!", r"macro_rules!", r"\bimpl\s+\w+", r"\btrait\s+\w+", r"\bstruct\s+\w+", r"\benum\s+\w+", r"\bmatch\s+\w+", r"\bunsafe\s+\{", r"\buse\s+\w+::", r"\bpub\s+(fn|struct|enum|trait|mod|use|type)", r"fn\s+main\s*\("],
    "python": [r"(?m)^def\s+\w+", r"(?m)^import\s+\w+", r"(?m)^from\s+\w+\s+import", r"(?m)^class\s+\w+", r"if\s+__name__\s*==\s*[\"']__main__[\"']", r"print\s*\(", r"\blambda\s+\w+\s*:", r"async\s+def\b", r"with\s+\w+\s+as\b"],
    "javascript": [r"function\s+\w+\s*\(", r"const\s+\w+\s*=\s*(\([^)]*\)\s*=>|[^;]*=>)", r"=>\s*\{", r"export\s+(default|const|function|class)\b", r"import\s+.*\s+from\s+['\"]", r"require\s*\(['\"]", r"console\.log\s*\(", r"document\.\w+", r"document\.getElementById\b", r"addEventListener\s*\(", r"async\s+function\b", r"await\s+\w+"],
    "typescript": [r":\s*(string|number|boolean|void|any|never|unknown)\b", r"interface\s+\w+", r"type\s+\w+\s*=", r"as\s+\w+", r"<\w+>", r"Array<\w+>"],
    "go": [r"(?m)^func\s+\w+", r"(?m)^package\s+main\b", r"import\s+\"", r"\bdefer\s+", r"\bgo\s+\w+\(", r"\bchan\s+", r"\bstruct\s*\{", r"\berr\s*!=\s*nil"],
    "java": [r"public\s+(static\s+)?(void|int|String|boolean|class|final)", r"System\.out\.println", r"@Override", r"class\s+\w+\s*(extends|implements)", r"private\s+\w+\s+\w+", r"protected\s+\w+"],
    "c": [r"#include\s*[<\"][^>\"]+[>\"]", r"int\s+main\s*\(", r"printf\s*\(", r"scanf\s*\(", r"\bNULL\b", r"\bsizeof\b", r"\bstruct\s+\w+", r"\bfree\s*\("],
    "cpp": [r"std::", r"#include\s*<iostream>", r"template\s*<.*>", r"cout\s*<<", r"cin\s*>>", r"::\w+\(", r"\bvirtual\b"],
    "ruby": [r"(?m)^def\s+\w+", r"(?m)^class\s+\w+", r"(?m)^module\s+\w+", r"attr_accessor\b", r"do\s*\|", r"end\b", r"require\s+['\"]", r"gem\s+['\"]"],
    "bash": [r"(?m)^#!", r"\bexport\s+\w+=", r"\bchmod\b", r"\bgrep\b", r"\bcurl\b", r"\bwget\b", r"\bapt-get\b", r"\byum\b", r"\bbrew\b", r"\[\[?\s+.*\s+\]\]?"],
    "html": [r"(?i)<!DOCTYPE\s+html", r"(?i)<html[\s>]", r"(?i)<div[\s>]", r"(?i)<body[\s>]", r"(?i)<head[\s>]", r"</\w+>", r"class\s*=\s*[\"']\w+"],
    "css": [r"@media\b", r"@import\b", r"@keyframes\b", r"\.\w+\s*\{", r"#\w+\s*\{", r"\bfont-size\b", r"\bdisplay\s*:", r"\bflex\b", r"\bgrid\b"],
    "yaml": [r"(?m)^---\s*$", r"(?m)^\w+:\s+\w+", r"(?m)^\s+-\s+\w+"],
    "sql": [r"(?is)\bSELECT\b.*\bFROM\b", r"(?i)\bCREATE\s+TABLE\b", r"(?i)\bINSERT\s+INTO\b", r"(?i)\bALTER\s+TABLE\b", r"(?i)\bWHERE\b.*=", r"(?i)\bJOIN\b"],
    "dockerfile": [r"(?m)^FROM\s+\w+", r"(?m)^RUN\s+", r"(?m)^CMD\s+", r"(?m)^COPY\s+", r"(?m)^WORKDIR\s+", r"(?m)^EXPOSE\s+\d+"],
}
SKIPPED_EXTENSIONS = [
    ".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".mp4", ".mp3", ".woff", ".woff2", ".ttf", ".ico",
]

# Repositories of well-known projects, by the name that a query uses.
KNOWN_REPOSITORIES = {
    "swe-agent": "princeton-nlp/SWE-agent",
    "swebench": "princeton-nlp/SWE-bench",
    "openhands": "All-Hands-AI/OpenHands",
    "opendevin": "All-Hands-AI/OpenHands",
    "autogpt": "Significant-Gravitas/AutoGPT",
    "langgraph": "langchain-ai/langgraph",
    "langchain": "langchain-ai/langchain",
    "crewai": "crewAIInc/crewAI",
    "autogen": "microsoft/autogen",
    "semantic kernel": "microsoft/semantic-kernel",
    "metagpt": "geekan/MetaGPT",
    "voyager": "MineDojo/Voyager",
    "memgpt": "cpacker/MemGPT",
    "letta": "letta-ai/letta",
    "codeact": "xingyaoww/code-act",
    "devika": "stitionai/devika",
    "chatdev": "OpenBMB/ChatDev",
    "toolllm": "OpenBMB/ToolLLM",
    "react": "reactjs/react.dev",
    "agentbench": "THUDM/AgentBench",
    "pytorch": "pytorch/pytorch",
    "tensorflow": "tensorflow/tensorflow",
    "fastapi": "fastapi/fastapi",
    "next.js": "vercel/next.js",
    "prisma": "prisma/prisma",
    "bun": "oven-sh/bun",
    "vite": "vitejs/vite",
    "deno": "denoland/deno",
    "tailwind": "tailwindlabs/tailwindcss",
}
# Terms and queries that stand for a domain of entities.
ENTITY_TERMS = {
    "ai_coding_agent": [
        "OpenHands", "SWE-agent", "SWE-bench", "AutoGPT", "LangGraph", "CrewAI", "MetaGPT", "AgentBench", "Reflexion", "ReAct", "Voyager", "MemGPT", "CodeAct", "OpenDevin", "Devin", "Devika", "AgentCoder", "ChatDev", "CodeGen", "ToolLLM", "Toolformer",
        "autonomous coding agent", "software engineering agent", "LLM agent framework", "self-correcting agent",
    ],
    "cybersecurity_competition": ["CTF", "DEF CON", "DEFCON CTF", "Cyber Challenge", "National Cyber League", "PicoCTF", "HackTheBox", "TryHackMe", "CyberPatriot", "SECCDC"],
    "llm_research_paper": ["LLM survey", "language model benchmark", "SOTA LLM"],
}
ENTITY_QUERIES = {
    "ai_coding_agent": [
        "SWE-agent autonomous coding agent architecture", "OpenHands AI software engineering agent", "ReAct reflexion self-correcting agent", "MemGPT memory-augmented LLM agent", "LangGraph agent planning execution", "AutoGPT autonomous task completion agent",
        "CrewAI multi-agent collaboration framework", "Devin Cognition autonomous software engineering agent", "best open source autonomous coding agents github", "LLM agent memory planning execution survey paper",
    ],
    "cybersecurity_competition": ["CTF cybersecurity competition winners 2026", "DEF CON CTF winning techniques tools", "cybersecurity competition writeup techniques"],
    "llm_research_paper": ["state of the art LLM survey 2026", "best open source LLM models comparison"],
}
# Least boosts of sources for a class of news.
NEWS_BOOSTS = {"cybersecurity": {"googlenews": 1.4, "twitter": 1.3}}
