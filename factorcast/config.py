"""Fixed values that results depend on.

Fixed values (must stay equal to the behaviour being reproduced):
  seed of the hold-out split ........ 397851846829394
  hold-out train fraction ........... 0.8 (test 0.2)
  cold-start prediction ............. 3.5
  number of time blocks ............. 50
  prequential round size ............ 400005 rows
  recall round size ................. 500 kept events
  replay passes over last-K buffer .. 2
  "positive" feedback threshold ..... rating > 0.9
  positive feedback code ............ "G" (1.0), anything else 0.0
  initial factor scale .............. 5 for explicit ratings, 1 for implicit

Deterministic initial factors (replacing an unseeded random draw):
  U(id, j) = ((id * 7919 + j * 104729 + salt) mod 10007) / 10007
  f_j      = sqrt(U(id, j) * scale / k);   salt 17 users, 71 products
"""

SEED = 397851846829394
TRAIN_FRACTION = 0.8
COLD_START = 3.5
N_BLOCKS = 50
PREQUENTIAL_ROUND = 400005
RECALL_ROUND = 500
REPLAY_PASSES = 2
POSITIVE_THRESHOLD = 0.9
POSITIVE_CODE = "G"
SCALE_EXPLICIT = 5.0
SCALE_IMPLICIT = 1.0

INIT_ID_MULT = 7919
INIT_J_MULT = 104729
INIT_MOD = 10007
USER_SALT = 17
PRODUCT_SALT = 71

# Virtual grid of stratified SGD (blocks of users x blocks of products) and the
# micro-batch of predict-then-learn.  Results depend on them; they are
# arguments everywhere and never follow row counts or cluster size.
GRID = 8
BATCH_ROWS = 1 << 16
