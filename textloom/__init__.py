"""textloom: lazy DataFrame operators for curating text corpora and scoring transcriptions."""
