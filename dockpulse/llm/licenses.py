"""Licence scans: Dice coefficient of word bigrams between texts and licence templates. Built-in functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockpulse.llm.workspace import stored

LEAST_DICE = 0.8
# Words that most texts have: poor marks, taken last.
COMMON = frozenset("a all an and any are as at be but by for from have if in is it may not of on or that the this to under with you".split())

# The notices by which works name their licence, and whole licences, as the licences' own texts word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> Counter:
    words = words_of(text)
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _known(templates: dict[str, str]) -> list[tuple[str, int, Counter]]:
    found = [(name, bigrams_of(text)) for name, text in sorted(templates.items())]
    return [(name, sum(b.values()), b) for name, b in found if b]


def marks(known: list[tuple[str, int, Counter]], least: float) -> list[str]:
    """Words of which every text that reaches `least` with a template has one.

    A match shares at least n * least / (2 - least) of a template's n bigrams. Words are taken, common ones last and long ones first, until fewer than that are without them.
    """
    found: set[str] = set()
    for _, n, grams in known:
        rest = {g: k for g, k in grams.items() if not found & set(g.split(" "))}
        for word in sorted({w for g in rest for w in g.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(rest.values()) < n * least / (2 - least) - 1e-6:
                break
            found.add(word)
            rest = {g: k for g, k in rest.items() if word not in g.split(" ")}
    return sorted(found)


def windows(texts: DataFrame, known: list[tuple[str, int, Counter]], least: float) -> DataFrame:
    """`uid, name, away, word`: for each text and template the best run of as many words as the template has, if it reaches `least`, and the place of its first word; of equal ones the first.

    `texts` has `uid` and `words`. An occurrence of a template's bigram counts for the runs that have it and not yet as many before it as the template has: one
    interval of starts. Running sums over the ends of these intervals give the shared bigrams of every run. Occurrences, not runs, are exchanged, by text and template.
    """
    rows = [(name, n, gram, k) for name, n, grams in known for gram, k in sorted(grams.items())]
    wanted = texts.sparkSession.createDataFrame(rows, "name string, m int, gram string, k int")
    grams = F.transform(F.slice("words", F.lit(1), F.size("words") - 1), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    every = texts.where(F.size("words") > 1).select("uid", (F.size("words") - 1).alias("n"), F.posexplode(grams).alias("at", "gram"))
    found = every.join(wanted, "gram").where("n >= m")
    same = Window.partitionBy("uid", "name", "gram").orderBy("at")
    before = F.coalesce(*[F.when(F.col("k") == k, F.lag("at", k).over(same)) for k in sorted({k for *_, k in rows})])
    found = found.select("uid", "name", "m", "n", "at", before.alias("before"))
    first = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("at") - F.col("m") + 1, F.lit(0))
    found = found.select("uid", "name", "m", first.alias("first"), F.least(F.col("at"), F.col("n") - F.col("m")).alias("last")).where("first <= last")
    ends = F.inline(F.array(F.struct(F.col("first").alias("word"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("word"), F.lit(-1).alias("step"))))
    steps = found.select("uid", "name", "m", ends).groupBy("uid", "name", "m", "word").agg(F.sum("step").alias("step"))
    along = Window.partitionBy("uid", "name").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = steps.select("uid", "name", "word", (-(2 * F.sum("step").over(along) / (F.col("m") + F.col("m")))).alias("away"))
    best = shared.where(-F.col("away") >= least).groupBy("uid", "name").agg(F.min(F.struct("away", "word")).alias("best"))
    return best.select("uid", "name", "best.away", "best.word")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """`doc_id, license, dice, line, word, n_matches` of every document: its best match, null without one, and how many there are.

    Compared, in lower-case letters a-z and digits, are each line, the whole text (line -1), and every run of as many words as a template has (line null, `word`
    the place of its first), so a notice is found inside a longer line and over several. Dice counts bigrams as often as they
    occur. A text of n bigrams can reach `least` only with templates of n * least / (2 - least) to n * (2 - least) / least, so all others
    are never compared, lines that no template suits are not even cut into words, and texts without any of the `marks` are not looked at further. The best match has the
    highest dice, then the first name, then the first line, the whole text before its lines and both before runs. A template counts once for each line and the whole
    text, and once for its best run. Null and empty texts match nothing; texts of any length are taken whole; rows that repeat are judged each; no rows give no rows; columns
    besides `doc_id` and `text` are not read. Templates are a bounded parameter and literals of the plan.
    """
    known = _known(templates)
    if not known:
        raise ValueError("no template has two words")
    shortest = int(min(n for _, n, _ in known) * least / (2 - least) - 1e-6)
    longest = int(max(n for _, n, _ in known) * (2 - least) / least + 1)
    literal = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(n).alias("n"),
                F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in sorted(grams.items())]).alias("grams"),
            )
            for name, n, grams in known
        ]
    )
    d = docs.select("doc_id", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9\n]+", " ").alias("t"))
    marked = F.arrays_overlap(F.split(F.translate("t", "\n", " "), " "), F.array(*[F.lit(w) for w in marks(known, least)]))
    every = stored(d.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.when(marked, F.col("t")).alias("t")), "license-texts")
    words = F.filter(F.split(F.translate("t", "\n", " "), " "), lambda w: w != "")
    runs = windows(every.where("t is not null").select("uid", words.alias("words")), known, least)
    d = every.where("t is not null")
    lines = F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(i.cast("int").alias("line"), F.trim(x).alias("text")))
    # the number of bigrams of a line, -1 if it has no word; only ASCII is left, so bytes are characters
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    sized = F.transform(
        lines,
        lambda u: F.struct(u["line"].alias("line"), u["text"].alias("text"), F.when(u["text"] == "", -1).otherwise(spaces(u["text"])).alias("n")),
    )
    d = d.select("uid", sized.alias("lines"))
    total = F.aggregate("lines", F.lit(-1), lambda s, u: s + u["n"] + 1)
    text = F.concat_ws(" ", F.transform(F.filter("lines", lambda u: u["n"] >= 0), lambda u: u["text"]))
    suits = lambda n: (n >= shortest) & (n <= longest)
    fitting = F.transform(
        F.filter("lines", lambda u: suits(u["n"])), lambda u: F.struct(u["line"].alias("line"), u["text"].alias("text"))
    )
    whole = F.array_compact(F.array(F.when(suits(total), F.struct(F.lit(-1).alias("line"), text.alias("text")))))
    d = d.select("uid", F.concat(whole, fitting).alias("units"))
    d = d.select("uid", F.transform("units", lambda u: F.struct(u["line"].alias("line"), F.split(u["text"], " ").alias("words"))).alias("units"))

    def pairs(u: Column) -> Column:
        start = F.slice(u["words"], F.lit(1), F.size(u["words"]) - 1)
        return F.transform(start, lambda w, i: F.concat_ws(" ", w, F.get(u["words"], i + 1)))

    d = d.select("uid", F.transform("units", lambda u: F.struct(u["line"].alias("line"), pairs(u).alias("grams"))).alias("units"))

    def dice(u: Column, t: Column) -> Column:
        shared = F.aggregate(
            t["grams"], F.lit(0), lambda s, g: s + F.least(g["k"], F.size(F.filter(u["grams"], lambda x: x == g["b"])))
        )
        return 2 * shared / (F.size(u["grams"]) + t["n"])

    def compared(u: Column) -> Column:
        n = F.size(u["grams"])
        # the highest dice that the sizes allow, by the division that the dice itself takes
        fit = F.filter(literal, lambda t: 2 * F.least(t["n"], n) / (n + t["n"]) >= least)
        return F.transform(
            fit, lambda t: F.struct((-dice(u, t)).alias("away"), t["name"].alias("name"), u["line"].alias("line"))
        )

    d = d.select("uid", F.explode(F.filter(F.flatten(F.transform("units", compared)), lambda m: -m["away"] >= least)).alias("m"))
    found = d.select("uid", "m.away", "m.name", F.lit(0).alias("place"), "m.line", F.lit(None).cast("int").alias("word"))
    nothing = F.lit(None).cast("int").alias("line")
    found = found.unionByName(runs.select("uid", "away", "name", F.lit(1).alias("place"), nothing, "word"))
    found = found.groupBy("uid").agg(F.min(F.struct("away", "name", "place", "line", "word")).alias("best"), F.count("*").cast("int").alias("n"))
    return every.join(found, "uid", "left").select(
        "doc_id",
        F.col("best.name").alias("license"),
        (-F.col("best.away")).alias("dice"),
        F.col("best.line").alias("line"),
        F.col("best.word").alias("word"),
        F.coalesce("n", F.lit(0)).alias("n_matches"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> str:
    """The same result of table `documents` as SQL: all lines, texts and runs of words against all templates."""
    rows = [f"('{name}', {n}, '{b}', {k})" for name, n, grams in _known(templates) for b, k in sorted(grams.items())]
    return f"""
  with d as (select row_number() over () r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') t
             from documents),
  u as (select r, -1 line, trim(regexp_replace(t, '[ \\n]+', ' ', 'g')) x from d
        union all
        select r, i - 1, trim(l[i]) from (select r, l, unnest(range(1, len(l) + 1)) i from (select r, string_split(t, chr(10)) l from d))),
  w as (select r, line, string_split(x, ' ') w from u),
  g as (select r, line, len(w) - 1 n, i - 1 p, w[i] || ' ' || w[i + 1] b
        from (select *, unnest(range(1, len(w))) i from w)),
  c as (select r, line, n, b, count(*) k from g group by r, line, n, b),
  t("name", size, b, k) as (values {", ".join(rows)}),
  m as (select r, line, "name", 2.0::double * sum(least(c.k, t.k)) / (n + size) dice
        from c join t using (b) group by r, line, n, "name", size having 2.0::double * sum(least(c.k, t.k)) / (n + size) >= {least}),
  v as (select r, "name", size, b, t.k, start, count(*) c
        from (select g.r, t.*, unnest(range(greatest(p - size + 1, 0), least(p, n - size) + 1)) start from g join t using (b) where line = -1 and n >= size) t
        group by all),
  y as (select r, "name", start, 2.0::double * sum(least(c, k)) / (size + size) dice from v group by r, "name", size, start),
  z as (select * from y where dice >= {least} qualify row_number() over (partition by r, "name" order by dice desc, start) = 1),
  a as (select r, dice, "name", 0 place, line, null word from m union all select r, dice, "name", 1, null, start from z),
  o as (select *, row_number() over (partition by r order by dice desc, "name", place, line) k, count(*) over (partition by r) n from a)
  select doc_id, "name" license, dice, cast(line as int) line, cast(word as int) word, cast(coalesce(n, 0) as int) n_matches
  from d left join (select * from o where k = 1) b on d.r = b.r"""
