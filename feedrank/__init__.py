"""feedrank: rank multi-source postings with DataFrame operators.

Every operator takes and returns DataFrames (or Columns); nothing in the
package reads the clock or the environment inside an operator.
"""

__version__ = "0.1.0"
