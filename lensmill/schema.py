"""Schemas and fixed values of the review domain."""

from __future__ import annotations

from pyspark.sql import types as T

#: The taxonomy's version, its categories in slot order (id and label), and those that stand alone.
SPINE_VERSION = "core-3"
CATEGORIES = (
    ("performance", "Performance"),
    ("bugs", "Bugs and crashes"),
    ("gameplay", "Gameplay and mechanics"),
    ("genre", "Genre and comparisons"),
    ("verdict", "Overall verdict only"),
    ("offtopic", "Says nothing about the game"),
    ("story", "Story and writing"),
    ("graphics", "Graphics and art"),
    ("audio", "Audio and music"),
    ("controls", "Controls and interface"),
    ("difficulty", "Difficulty and balance"),
    ("content", "Amount of content"),
    ("price", "Price and value"),
    ("monetisation", "Monetisation and DLC"),
    ("multiplayer", "Multiplayer and online"),
    ("community", "Community and players"),
    ("updates", "Updates and developer support"),
    ("policy", "Publisher and platform policy"),
    ("compatibility", "Hardware and compatibility"),
    ("accessibility", "Accessibility and options"),
    ("language", "Language and localisation"),
)
#: What belongs to each category, in a sentence: the text of its first anchor and of the labelling brief.
DESCRIPTIONS = {
    "performance": "How fast and smoothly it runs: frame rate, stutter, loading times, heat.",
    "bugs": "What is broken: crashes, errors, lost progress, things that do not work as meant.",
    "gameplay": "What the player does: rules, combat, systems, how it feels to play.",
    "genre": "What kind of game it is and which other games it is like or unlike.",
    "verdict": "Good or bad, recommended or not, with no reason given.",
    "offtopic": "Jokes, memes, drawings and talk that say nothing about the game.",
    "story": "Plot, characters, dialogue, world and how they are written.",
    "graphics": "How it looks: art, models, effects, animation.",
    "audio": "How it sounds: music, effects, voices.",
    "controls": "Keys, controllers, camera, menus and other parts of the interface.",
    "difficulty": "How hard or easy it is, fairness and balance of its parts.",
    "content": "How much there is: length, variety, repetition, replay.",
    "price": "What it costs and whether it is worth that, sales and refunds.",
    "monetisation": "Extra payments: expansions, cosmetics, passes, loot boxes.",
    "multiplayer": "Playing with others: servers, matchmaking, cooperation, lag.",
    "community": "The other players: behaviour, cheating, friendliness, mods they make.",
    "updates": "What the developers did since release: patches, promises, support, abandonment.",
    "policy": "What publisher or platform impose: accounts, launchers, copy protection, bans, regions.",
    "compatibility": "Which machines, systems and devices it works on.",
    "accessibility": "Options for different needs: text size, colours, subtitles, remapping.",
    "language": "Translations, missing languages and the quality of both.",
}
#: Where two categories meet, the one that a review belongs to.
BOUNDARIES = (
    ("performance", "bugs", "Slow is performance; a stop or an error is bugs."),
    ("compatibility", "bugs", "It never works on this machine: compatibility. It works and then breaks: bugs."),
    ("price", "monetisation", "The price of the game itself is price; any payment after that is monetisation."),
    ("multiplayer", "community", "Servers and modes are multiplayer; the people met there are community."),
    ("updates", "policy", "A change to the game is updates; a condition for playing it is policy."),
    ("controls", "accessibility", "A control that is bad for all is controls; an option that some need is accessibility."),
)
ALONE = ("verdict", "offtopic")
CATEGORY_IDS = tuple(c for c, _ in CATEGORIES)
ALONE_SLOTS = tuple(CATEGORY_IDS.index(c) for c in ALONE)
#: Similarity margin of a mention, most mentions before only the primary stands, size of the top of the pile.
MENTION_MARGIN, MOST_MENTIONS, TOP_HELPFUL = 0.02, 4, 50
#: Store language names, their BCP-47 tags and display names; the one written right to left.
LANGUAGES = (
    ("english", "en", "English"),
    ("schinese", "zh-Hans", "Chinese (simplified)"),
    ("tchinese", "zh-Hant", "Chinese (traditional)"),
    ("japanese", "ja", "Japanese"),
    ("koreana", "ko", "Korean"),
    ("thai", "th", "Thai"),
    ("bulgarian", "bg", "Bulgarian"),
    ("czech", "cs", "Czech"),
    ("danish", "da", "Danish"),
    ("german", "de", "German"),
    ("greek", "el", "Greek"),
    ("spanish", "es", "Spanish"),
    ("latam", "es-419", "Spanish (Latin America)"),
    ("finnish", "fi", "Finnish"),
    ("french", "fr", "French"),
    ("hungarian", "hu", "Hungarian"),
    ("indonesian", "id", "Indonesian"),
    ("italian", "it", "Italian"),
    ("dutch", "nl", "Dutch"),
    ("norwegian", "no", "Norwegian"),
    ("polish", "pl", "Polish"),
    ("portuguese", "pt", "Portuguese"),
    ("brazilian", "pt-BR", "Portuguese (Brazil)"),
    ("romanian", "ro", "Romanian"),
    ("russian", "ru", "Russian"),
    ("swedish", "sv", "Swedish"),
    ("turkish", "tr", "Turkish"),
    ("ukrainian", "uk", "Ukrainian"),
    ("vietnamese", "vi", "Vietnamese"),
    ("arabic", "ar", "Arabic"),
    ("malay", "ms", "Malay"),
)
RIGHT_TO_LEFT = ("ar",)

#: Columns of a captured review, in order, with the type of each; ids and raw_json are never null.
CAPTURE = T.StructType(
    [
        T.StructField("recommendationid", T.StringType()),
        T.StructField("appid", T.LongType()),
        T.StructField("author_steamid", T.StringType()),
        T.StructField("author_num_games_owned", T.LongType()),
        T.StructField("author_num_reviews", T.LongType()),
        T.StructField("author_playtime_forever", T.LongType()),
        T.StructField("author_playtime_at_review", T.LongType()),
        T.StructField("author_playtime_last_two_weeks", T.LongType()),
        T.StructField("author_last_played", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("timestamp_created", T.LongType()),
        T.StructField("timestamp_updated", T.LongType()),
        T.StructField("voted_up", T.BooleanType()),
        T.StructField("votes_up", T.LongType()),
        T.StructField("votes_funny", T.LongType()),
        T.StructField("weighted_vote_score", T.DoubleType()),
        T.StructField("comment_count", T.LongType()),
        T.StructField("steam_purchase", T.BooleanType()),
        T.StructField("received_for_free", T.BooleanType()),
        T.StructField("written_during_early_access", T.BooleanType()),
        T.StructField("refunded", T.BooleanType()),
        T.StructField("primarily_steam_deck", T.BooleanType()),
        T.StructField("raw_json", T.StringType()),
    ]
)
CRAWL = "id bigint, app_id bigint, snapshot_unix bigint, params_url string, valve_total bigint, finished_unix bigint"
SHARD = "crawl_id bigint, idx bigint, start_date bigint, end_date bigint, expected bigint, status string, row_count bigint, pages bigint, stop_reason string, max_created bigint"
WATERMARK = "app_id bigint, max_created bigint, updated_unix bigint"
CLASSIFICATIONS = "recommendationid string, appid bigint, primary_category string, primary_score float, mentions array<string>, spine_version string, anchors string"
LABELS = "id string, primary string, secondary array<string>, ironic boolean, confidence string, subset string, ambiguous boolean"
