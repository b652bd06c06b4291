"""Column names, codes and schemas of the lake and of the warehouse tables."""

from __future__ import annotations

#: Category, information and shop codes; statuses; table codes of images.
CATEGORY_RESTAURANT, CATEGORY_DEFAULT = "CA01", "CA07"
INFORMATION_RESTAURANT, INFORMATION_IT = "IC01", "IC02"
SHOP_CODES = ("SC01", "SC02", "SC03", "SC04", "SC05", "SC06")
STATUS_ACTIVE, POST_DEFAULT = "ST01", "PT01"
TABLE_SHOP, TABLE_CRAWLING = "TC08", "TC10"
PLACEHOLDERS = ("", "-", "N/A")
BOOTSTRAP_DAYS = 90


#: Schemas are DDL strings: they need no session to be read.
NEWS_ROW = (
    "title string, content string, article_url string, created_at string, thread string, category_cd string, information_cd string, "
    "view_count int, comment_count int, point double, author string, map_id long, shop_cd string, keywords string"
)
ANALYSIS = (
    "crawling_id long, title string, content string, article_url string, map_id long, shop_id long, category_cd string, "
    "information_cd string, shop_cd string, created_dt timestamp_ntz, sentimental string, score double, keywords string"
)
CRAWLING = (
    "crawling_id long, title string, content string, thread string, article_url string, created_at timestamp_ntz, view_count int, "
    "comment_count int, point double, author string, map_id long, category_cd string, information_cd string, shop_cd string, keywords string"
)
CODES = "cd string, name string, cd_info string, cd_upper string"
MENU = "name: string, price: int"
REVIEW = (
    "content: string, author: string, visited_at: string, rating: double, sub_evaluations: map<string, string>, "
    "ordered_menus: array<string>, keywords: array<string>, review_images: array<string>, source_review_id: string"
)
STORE = "entity_id: string, name: string, full_address: string, address_cd: string, address_detail: string, rating: double, canonical_url: string, is_active: boolean"
CANDIDATE = (
    f"batch_id string, run_attempt int, entity_id string, entity_ref map<string, string>, store struct<{STORE}>, menus array<struct<{MENU}>>, "
    f"reviews array<struct<{REVIEW}>>, images array<struct<url: string>>"
)
FAIL_RECORD = (
    "batch_id string, run_attempt int, stage string, entity_type string, entity_id string, entity_ref map<string, string>, status string, "
    "reason_code string, retry_count int, created_at timestamp_ntz, detail string, data string"
)
ARTICLE = (
    "schema_version string, article_id string, source string, category_cd string, title string, content string, url string, content_hash string, "
    "batch_id string, run_attempt int, published_at string"
)
RECIPE = "recipe_search_keyword string, recipe_url string, ingredients array<struct<ingredient_name: string>>"
