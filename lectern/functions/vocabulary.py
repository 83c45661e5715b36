"""Fixed values of the annotation scheme: tags, families and orders."""

# Wrapper tags by family, in their natural order.
WRAPPERS = {
    "token": ("morph", "norm_func", "norm_head", "norm_xml:id", "norm_new_sent"),
    "edition": ("ed_line_n", "ed_lb_n", "ed_page_n", "ed_pg_n"),
    "multiword": ("multiword",),
    "reference": ("chapter_n", "marcion_chapter_n", "marcion_verse_n", "petermann_chapter_n", "petermann_verse_n"),
    "editorial": ("hi_rend", "note", "gap_reason", "supplied_reason", "note_note", "gap_unit", "supplied_source", "gap_quantity", "gap_extent", "supplied_evidence", "unclear_reason", "unclear"),
    "intervention": ("gap", "supplied", "abbr"),
    "entity_source": ("entity_head_tok", "entity_text", "entity_identity", "persName_type", "placeName_type", "placeName_ref", "roleName_type", "rs_type", "org_type"),
    "document_source": ("pb_coptic_id", "p_n", "p", "p_source", "pb_n", "lb_nb"),
    "alternate_reference": ("verse", "verse_n_vid_n", "verse_n_vname", "v_id", "vid__n", "chapter_name", "ed_chapter_n", "chapter_2", "ch_n", "chapter"),
    "residual": (
        "date_type", "german", "section_title", "quote_ref", "quote_type", "gap_exent", "ignore_note", "ed_page", "sup", "supplied_quantity", "supplied_unit", "sic", "surplus", "source_lang",
        "pb", "add_place", "pb_id", "sub", "gap_reasaon", "gap_reasonn", "hi", "surplus_reason", "cb", "del_rend", "figDesc", "figure", "pb_coptic_xml",
    ),
    "translation_source": ("trans_horner",),
}
# Attributes that an intervention may have.
INTERVENTION_KEYS = {"gap": ("gap", "extent", "reason", "unit"), "supplied": ("supplied", "source", "reason"), "abbr": ("type",)}
# Layout tags with the kind of their point event.
LAYOUT = {"pb_xml_id": "page", "cb_n": "column", "lb_n": "line"}
# Verse markers, outermost first.
VERSE = ("verse_n", "vid_n", "verse_vid")
# Wrappers outside the families, with their tracks.
SOURCE_TRACKS = {"sbl_greek": "sbl", "sbl_apparatus": "sbl", "lang": "lang"}
# Node types in the order of their ids.
NODE_TYPES = (
    "document", "sentence", "orig_group", "norm_group", "orig", "page", "column", "line", "verse_n_marker", "vid_n_marker", "verse_vid_marker",
    "entity", "translation", "arabic_translation", "sbl_greek", "sbl_apparatus", "lang", *(kind for family in WRAPPERS.values() for kind in family),
)

TRACK = {**SOURCE_TRACKS, **{kind: family for family, kinds in WRAPPERS.items() for kind in kinds}}


def value_key(kind: str) -> str:
    """The attribute that holds a wrapper's value."""
    return {"hi": "rend", "abbr": "type"}.get(kind, kind)
