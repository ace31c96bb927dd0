"""Rows that every operator meets."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, start long, "
          "block int, word binary, rank int, size long, shard int, id long, node long, bucket long, part int, trained boolean")


def rows():
    """Null and empty texts, a long text, ties, repeated rows, odd characters, near copies; null id, language."""
    words = [f"w{i % 97}x{i % 31}" for i in range(400)]
    base = " ".join(words[:200])
    near = " ".join(words[:150] + ["changed"] + words[151:200])
    texts = [None, "", " \n\t ", "a", base, base, near, "The Cat sat.\nThe Cat sat.\nthe end", "x " * 5000, "日本語 ｶﾅ é é  \x1c\x85 <|endoftext|> 'S it's",
             "\n".join(["one line of five words"] * 12 + words[:60]), " ".join(words), "Ça va bien, merci! Où est la gare?", "12 34 !!! ###", "\U0001F600 ​"]
    out = [(i, t, ["en", "fr", None][i % 3], "s", None, 1.0, True, 7, 3, b"k", 1, 2, 3, 4, 5, 6, 7, False) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, base, "en", *out[0][3:]), (None, None, None, *out[0][3:])]
