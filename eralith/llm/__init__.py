"""Training-data operators: deduplication, scoring, fingerprints, joins, encoding, filtering, scans and packing.

Conventions shared by every operator here
-----------------------------------------
* An operator takes a DataFrame and the names of its id and text columns, selects just those columns under private
  names at once (so further columns, whatever they are called, cannot clash) and returns a DataFrame. Where an operator has
  to look at its data on the way (a count, a filter of ids, a table that cuts the lineage), it runs these jobs when called.
* A row without an id can be neither reported nor linked: it is left out of the result and supplies nothing.
* A null text is an empty text. Empty tables give empty results with the same schema.
* Repeated ids are told apart by their text; identical rows give identical result rows, one for each.
"""
