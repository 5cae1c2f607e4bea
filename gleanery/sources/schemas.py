"""Explicit schemas of files that come from outside; nothing is inferred."""

RAW_PAGE = (
    "url string, domain string, timestamp string, depth int, http_status_code int, content_length bigint, content_hash string, last_crawl_time string, "
    "previous_change_time string, expected_next_crawl string, backoff_multiplier int, crawl_count int, change_frequency double, content string"
)
DOCUMENT = (
    "document_id string, url string, title string, domain string, description string, content_type string, categories array<string>, keywords array<string>, canonical_url string, published_date string, "
    "modified_date string, author_name string, primary_image struct<src:string,alt:string>, semantic_info struct<word_count:int,content_quality_score:double,is_technical_content:boolean,domain_score:double>"
)
CHUNK = "chunk_id string, document_id string, text_chunk string, relevant_headings array<string>, chunk_index int, word_count int"
FEED = "url string, poll_interval int, priority int"
DOMAIN_CONFIG = "struct<crawl_frequency:struct<interval:string,use_freshness_based:boolean,multiplier:double>,language_whitelist:array<string>,enabled:boolean,priority_multiplier:double>"
