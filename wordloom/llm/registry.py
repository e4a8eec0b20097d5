"""The queries of this subpackage and their SQL twins."""

from functools import wraps

from wordloom.llm.common import small_batches
from wordloom.llm.decontamination import OP2_SQL, op2_decontamination
from wordloom.llm.language_id import op9_language_id
from wordloom.llm.licenses import op1_license_scan
from wordloom.llm.lm_scoring import op10_lm_scoring
from wordloom.llm.mixing import OP7_SQL, op7_mixing
from wordloom.llm.near_dedup import OP5_SQL, op5_near_dedup
from wordloom.llm.quality_classifier import op4_quality_classifier
from wordloom.llm.quality_rules import OP3_SQL, op3_quality_rules
from wordloom.llm.token_counts import op6_token_counts
from wordloom.llm.warc import OP8_SQL, op8_warc_fixity



def _query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        small_batches(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _query(f)
    for f in (
        op1_license_scan,
        op2_decontamination,
        op3_quality_rules,
        op4_quality_classifier,
        op5_near_dedup,
        op6_token_counts,
        op7_mixing,
        op8_warc_fixity,
        op9_language_id,
        op10_lm_scoring,
    )
}
SQL = {"op2_decontamination": OP2_SQL, "op3_quality_rules": OP3_SQL, "op5_near_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op8_warc_fixity": OP8_SQL}
