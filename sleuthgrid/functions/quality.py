"""Is a page, a host or a name content, or furniture? Column expressions that say so, with a reason."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import host_of, strip_space

# fixed values: paths, phrases and marks of pages that hold no content, in the order in which they are looked for
AUTH_PATH = r"(?i)/(?:login|signin|sign-in|register|subscribe|paywall|account/login)(?:[/?#]|$)"
PAYWALL = (
    "sign in to continue", "subscribe to read", "subscribe to continue", "log in to read", "login to continue", "this content is for subscribers",
    "create an account to read", "you have reached your article limit", "please sign in to access", "members only",
)
BLOCKED = (
    "checking your browser", "just a moment", "recaptcha", "captcha", "are you a robot", "are you human", "access denied", "403 forbidden",
    "attention required", "verify you are human", "bot verification", "enable javascript to continue", "please enable cookies", "ddos protection", "cloudflare ray id",
)
HEAD, FEW_WORDS, THIN_WORDS = 1500, 60, 200
# fixed values: hosts, host prefixes and file endings of what a page loads or is shared by
SOCIAL = (
    "facebook.com", "fb.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "youtu.be", "instagram.com", "pinterest.com", "reddit.com",
    "whatsapp.com", "t.me", "telegram.me", "tiktok.com", "threads.net", "bsky.app", "mastodon.social", "flipboard.com", "tumblr.com",
)
ASSET_HOST = r"^(cdn[.-]|assets?[.-]|static[.-]|img[.-]|images\.|media\.|cache\.|thumbs\.|video\.|player\.|fonts\.|analytics\.|tracking\.|pixel\.|ads\.)"
ASSET_FILE = r"\.(jpg|jpeg|png|gif|webp|svg|ico|bmp|css|js|mjs|map|woff|woff2|ttf|eot|mp4|webm|mp3|m3u8)$"


def word_count(c: Column) -> Column:
    return F.when(strip_space(c) == "", 0).otherwise(F.size(F.split(strip_space(c), r"(?U)[\s\x1c-\x1f]+")))


def rejection_reason(url: Column, content: Column, title: Column, few: int = FEW_WORDS) -> Column:
    """Why a page isn't usable content, or an empty string: login path, paywall phrase at the head, mark of a blocked page in the title or at the head of a thin page, too few words."""
    content, title = F.coalesce(content, F.lit("")), F.lower(strip_space(F.coalesce(title, F.lit(""))))
    head, n = F.lower(F.substring(content, 1, HEAD)), word_count(content)
    out = F.when(F.coalesce(url, F.lit("")).rlike(AUTH_PATH), "login or paywall page")
    for phrase in PAYWALL:
        out = out.when(F.contains(head, F.lit(phrase)), f"paywalled content ({phrase})")
    for mark in BLOCKED:
        out = out.when(F.contains(title, F.lit(mark)) | (F.contains(head, F.lit(mark)) & (n < THIN_WORDS)), f"anti-bot or interstitial page ({mark})")
    return out.when(n < few, F.concat(F.lit("only "), n.cast("string"), F.lit(" words of content"))).otherwise("")


def web_chrome(name: Column, kind: Column) -> Column:
    """A URL or domain that is a page's furniture: a social host, an asset host or an asset file."""
    host = host_of(name)
    social = host.rlike(r"(^|\.)(" + "|".join(map(re.escape, SOCIAL)) + ")$")
    path = F.regexp_extract(F.lower(strip_space(name)), "^[^?#]*", 0)
    return F.coalesce(kind.isin("URL", "Domain") & (host != "") & (social | host.rlike(ASSET_HOST) | path.rlike(ASSET_FILE)), F.lit(False))


def malformed_host(name: Column, kind: Column) -> Column:
    """A URL or domain name that can't be one: a bare ending, a single label, the tail of an encoded URL, a first label of one character."""
    raw = F.lower(strip_space(F.coalesce(name, F.lit(""))))
    first, n = F.substring_index(raw, ".", 1), F.size(F.split(raw, r"\."))
    tail = first.rlike("^(?:2f|3a|3d|25|20)[a-z0-9-]*$") & (n > 2)
    return F.coalesce(kind.isin("URL", "Domain") & ~raw.startswith("http") & ((n < 2) | tail | (F.length(first) < 2)), F.lit(False))


#: Name of vessels and of drones (fixed values).
VESSEL = r"^(MV|M/V|MT|M/T|SS|S/S|MS|M/S|RFA|RV|USS|USNS|HMS|HMAS|HMCS|HMNZS|FS|FGS|INS|BRP|KRI|ROKS|JS|ARA|NRP|ITS|ESPS|TCG|BNS|CNS|HTMS|KD|PNS|RSS|SPS)\s+\S"
DRONE = r"^(?i)(MQ|RQ)-\d"
GENERIC = ("Custom", "Organization", "Technology", "Infrastructure", "Product", "Person", "", "EquipmentType", "Equipment", "Vehicle", "Asset", "Platform", "System")


def type_hint(name: Column, kind: Column) -> Column:
    """Ship or Drone for a name by their conventions, if the type given is a generic one."""
    hint = F.when(name.rlike(VESSEL), "Ship").when(name.rlike(DRONE), "Drone")
    return F.when(F.coalesce(kind, F.lit("")).isin(*GENERIC), F.coalesce(hint, kind)).otherwise(kind)
