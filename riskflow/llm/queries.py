"""The queries of this subpackage by name."""

from __future__ import annotations

from riskflow.llm.collocations import op11_collocations
from riskflow.llm.decontamination import op8_decontamination
from riskflow.llm.negatives import op13_negatives
from riskflow.llm.neighbours import op5_neighbours
from riskflow.llm.packing import op12_packing
from riskflow.llm.quality import op2_quality
from riskflow.llm.segmentation import op6_segmentation
from riskflow.llm.sharding import op7_sharding
from riskflow.llm.simhash import op9_simhash
from riskflow.llm.suffixes import op10_suffixes
from riskflow.llm.token_files import op4_token_files
from riskflow.llm.toxicity import op3_toxicity
from riskflow.llm.warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_neighbours": op5_neighbours,
    "op6_segmentation": op6_segmentation,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_suffixes": op10_suffixes,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_negatives": op13_negatives,
}
