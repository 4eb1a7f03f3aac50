"""wattle: smart-meter load-shape analytics on Spark DataFrames.

Four families of work, each a function ``DataFrame -> DataFrame``:

* ``operators.prepare``   raw readings -> complete days -> daily points -> seed centroids
* ``operators.ksc``       shift-invariant k-means (K-SC): assign, update, fit, K sweep,
                          quality (SST/SSB/SSW, coverage, Calinski-Harabasz), tags, entropy
* ``operators.profile``   per (meter, hour) lag-and-temperature regression -> activity profile
* ``operators.synthesize`` synthetic load + temperature series from fitted profiles
"""

__version__ = "0.1.0"
