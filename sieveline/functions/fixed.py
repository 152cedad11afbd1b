"""Word lists, markers, patterns and weights that results depend on, in natural order."""

SEARCH_STOPWORDS = ["a", "an", "and", "are", "by", "can", "company", "companies", "find", "for", "from", "in", "list", "me", "of", "on", "or", "show", "some", "the", "to", "top", "with", "you"]
#: The usual short English list of full-text engines.
RETRIEVAL_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
BOILERPLATE_SNIPPETS = ["sign in to continue", "page not found", "click here"]
FILE_EXTENSIONS = [".pdf", ".ppt", ".pptx", ".doc", ".docx"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "vimeo.com", "www.vimeo.com"]
OFFICIAL_PATHS = ["/about", "/company", "/contact", "/team", "/product", "/platform"]
THIRD_PARTY = ["best", "top", "review", "reviews", "alternatives", "compare", "comparison", "directory", "list", "roundup", "news"]
LOW_HOSTS = ["reddit.com", "quora.com", "facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "tiktok.com", "youtube.com", "pinterest.com"]
GENERIC_SUBDOMAINS = ["www", "app", "blog", "docs", "help", "support"]
BUCKETS = ["official_entity", "profile_directory", "editorial_reference", "roundup_list", "transactional_listing"]
BUCKET_CAPS = [4, 4, 3, 3, 2]
GENERIC_PHRASES = ["ai startups", "healthcare ai startups", "healthcare companies", "top restaurants", "best phones", "open source tools"]
GENERIC_DESCRIPTORS = ["ai", "best", "clinical", "companies", "company", "healthcare", "leading", "most", "open", "phones", "popular", "recommended", "restaurants", "source", "startups", "tools", "top"]
GENERIC_HEADS = ["apps", "companies", "company", "datasets", "phones", "platforms", "products", "restaurants", "services", "solutions", "startups", "tools"]
GENERIC_LEADS = ["best", "leading", "most", "popular", "recommended", "top"]
BOILERPLATE_LABELS = ["about", "about us", "contact", "overview", "portfolio", "pricing", "products", "services", "solutions", "team"]
WEAK_SINGLES = ["app", "company", "directory", "guide", "marketplace", "overview", "platform", "portfolio", "restaurant", "service", "software", "solution", "startup", "team", "tool"]
#: Passage lines that are dropped when they are all of a line, as alternatives of a pattern.
BOILERPLATE_LINES = [
    r"read more(?:\s+below)?(?:\.\.\.)?", "read full review", "learn more", r"show pros\s*&\s*cons", r"hide pros\s*&\s*cons", r"show \d+ more show top \d+ only", "jump to(?::| see more details)?", "skip to main content",
    "become a techradar insider(?: now)?", "join our community", "join now", r"sign up(?: for breaking news, reviews, opinion, top tech deals, and more\.)?", "commenting access", "member badges", "exclusive deals",
    "find out about our magazine", "find out more", "my account", "earn your first badge", "keep earning badges", "latest in phones", "latest in computing", "start reading", "your membership perks", "explore now",
    "member exclusives", "member rewards", "see rewards", "sign out", "share", "follow us", "newsletter", "you are now subscribed", "your newsletter sign-up was successful", "join the club", "explore", r"terms\s*&\s*conditions",
    "privacy policy", "check(?: on amazon)?", "view deal",
]
#: Weights of passage ranking: base, best rewrite, rewrite coverage, span, anchors.
PASSAGE_WEIGHTS = (0.45, 0.25, 0.10, 0.10, 0.10)
#: Weights of entity support: sources, variants, quality, rank, chunks, spread.
SUPPORT_WEIGHTS = (0.30, 0.20, 0.20, 0.10, 0.10, 0.10)
#: Weights of an entity's alignment with its query: BM25, span, anchors.
ALIGNMENT_WEIGHTS = (0.60, 0.20, 0.20)
#: Weights of a passage for a cell: presence of the entity, match of the column, match of the query, cleanliness.
CELL_WEIGHTS = (0.20, 0.50, 0.20, 0.10)
#: Of a column's match: shared terms, longest run; of a query's match: BM25, span, anchors.
COLUMN_WEIGHTS, QUERY_WEIGHTS = (0.7, 0.3), (0.6, 0.2, 0.2)
RESULT_COUNTS = {1: 20, 2: 15, 3: 12, 4: 10}
RETRY_COUNTS = {1: 32, 2: 21, 3: 16, 4: 13}
#: Stage, key and label of every figure that a stage shows.
METRICS = [
    ("planner", "columnsSelected", "Columns selected"),
    ("searcher", "queriesRun", "Queries run"), ("searcher", "sourcesFound", "Sources found"), ("searcher", "shortlisted", "Shortlisted"),
    ("searcher", "officialSources", "Official sources"), ("searcher", "profileSources", "Profile sources"), ("searcher", "roundupSources", "Roundup sources"),
    ("searcher", "editorialReferenceSources", "Editorial reference sources"), ("searcher", "transactionalSources", "Transactional sources"),
    ("searcher", "sourcesProcessed", "Sources deep-fetched"), ("searcher", "relevantDetailsFound", "Relevant details found"),
    ("searcher", "passagesScored", "Passages scored"), ("searcher", "passagesSelected", "Passages selected"), ("searcher", "sourcesRepresented", "Sources represented"),
    ("extractor_light", "preliminaryCandidates", "Preliminary candidates"), ("extractor_light", "mentionsFound", "Mentions found"),
    ("assessor", "sourcesReviewed", "Sources reviewed"), ("assessor", "filteredOut", "Filtered out"), ("assessor", "usedForEvidence", "Used for evidence"),
    ("assessor", "candidatesWithEvidence", "Candidates with evidence"), ("assessor", "supportingSourcesLinked", "Supporting sources linked"),
    ("extractor", "coreCandidatesKept", "Core candidates kept"), ("extractor", "discoveryCandidatesKept", "Discovery candidates kept"),
    ("extractor", "coreCandidatesFiltered", "Core candidates filtered"), ("extractor", "discoveryCandidatesFiltered", "Discovery candidates filtered"),
    ("extractor", "profilesBuilt", "Profiles built"), ("extractor", "missingFields", "Missing fields"),
    ("finalizer", "rowsReady", "Rows ready"),
]
#: What a run says of an empty query, of one that is no topic, and of its own failure.
EMPTY_QUERY = "Query is empty. Please provide a topic describing entities to discover."
NO_TOPIC = "This query is not a supported entity-discovery topic."
RUN_FAILED = "Something went wrong while running the research pipeline."
