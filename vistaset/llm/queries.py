"""The queries of this subpackage, for the driver's entry module, and their SQL where SQL can express them."""

from __future__ import annotations

import functools

from . import collocations, lines, vector_codes
from .bpe import op7_bpe
from .collocations import op12_collocations
from .common import ship
from .descent import op4_descent
from .framed import op9_token_files
from .jaccard import op8_jaccard
from .licenses import op5_licenses
from .lines import op13_lines
from .markov import op3_markov
from .mixing import op10_mix
from .order_minhash import op6_order_minhash
from .pii import op2_pii
from .quality import op1_quality
from .vector_codes import op11_vector_codes


def shipped(f):
    """The query, with this package sent to the executors first where they lack it."""

    @functools.wraps(f)
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return query


QUERIES = {n: shipped(f) for n, f in {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_markov": op3_markov,
    "op4_descent": op4_descent,
    "op5_licenses": op5_licenses,
    "op6_order_minhash": op6_order_minhash,
    "op7_bpe": op7_bpe,
    "op8_jaccard": op8_jaccard,
    "op9_token_files": op9_token_files,
    "op10_mix": op10_mix,
    "op11_vector_codes": op11_vector_codes,
    "op12_collocations": op12_collocations,
    "op13_lines": op13_lines,
}.items()}
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": vector_codes.SQL, "op12_collocations": collocations.SQL, "op13_lines": lines.SQL}
