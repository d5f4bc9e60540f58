"""Template-family rules and other small fixed dimensions.

All values here are fixed values of the migrated tool.  They are kept as
Python rows and turned into Column expressions (``CASE`` chains) by the
operators, so matching a token against a rule needs no join.
"""
from __future__ import annotations


# (family, priority, marker kind, marker key): the first family whose marker
# appears on the home page wins; the marker is also the main-content element.
FAMILY_MARKERS = [
    ("B", 1, "class", "columnsContent"),
    ("O", 2, "id", "slot-main"),
    ("T", 3, "id", "content"),
    ("W", 4, "class", "wrap__page-content--inner"),
]
UNKNOWN_FAMILY = "X"

# Navigation roots: (family, priority, kind, key, root_is_list).  When the
# root is the list itself its ``li`` children are level 1; otherwise level 1
# is ``root > ul > li``.  For W the header menu wins over the body menu.
NAV_ROOTS = [
    ("B", 1, "id", "mainMenu", True),
    ("O", 1, "id", "slot-navigation", False),
    ("T", 1, "id", "nav", True),
    ("W", 1, "id", "navigation_header", False),
    ("W", 2, "id", "navigation_body", False),
]
# Level-1 items with this class are separators, not menu items (family B).
NAV_EXCLUDED_CLASS = {"B": "sep"}

# Stylesheet matchers: link elements whose href contains the text; every
# matcher of the family must match for any stylesheet to be migrated.
STYLESHEET_MATCHERS = [
    ("B", 1, "global.css"),
    ("O", 1, "layout.css"),
    ("O", 2, "customer.css"),
    ("W", 1, "custom.css"),
]

# Logo roots: (family, kind, key, image_is_root).  The logo is the first
# image under the root, or the root itself when image_is_root.
LOGO_ROOTS = [
    ("B", "class", "headerPkg", False),
    ("O", "class", "logo-phone-wrapper-inner", False),
    ("T", "id", "headerWrapper", False),
    ("W", "class", "logo__image", True),
]
# Family T also migrates the site title and subtitle text.
LOGO_TEXT = [("T", "title", "website-title"), ("T", "description", "website-subtitle")]
LOGO_CDN = "cdcssl.ibsrv.net"

# Component aliases written for every site.
COMPONENT_ALIASES = [
    ("navigation", "navigation_header"), ("navigation", "navigation_body"), ("navigation", "partial_nav"),
    ("logo", "logo_header"), ("logo", "logo_home"), ("logo", "logo_footer"),
    ("locations", "locations_header"), ("locations", "locations_footer"),
    ("locations", "location_header"), ("locations", "location_footer"),
    ("maps", "map_home"), ("maps", "map_body"), ("maps", "map_fullwidth"), ("maps", "map_contact"),
]

# Social accounts (L4): token -> (url prefix, label, icon class).
SOCIAL_MEDIA = [
    ("facebook_domain", "https://www.facebook.com/", "Facebook", "icon-facebook"),
    ("twitter_username", "https://www.twitter.com/", "Twitter", "icon-twitter"),
    ("Yelp_url", "", "Yelp", "icon-yelp"),
    ("GooglePlus_url", "", "Google Plus", "icon-google-plus"),
    ("YouTube_url", "", "YouTube", "icon-youtube"),
]

# Day numbers of the legacy hours string (L3).
DAY_NAMES = [("1", "sunday"), ("2", "monday"), ("3", "tuesday"), ("4", "wednesday"),
             ("5", "thursday"), ("6", "friday"), ("7", "saturday")]
