"""Word lists whose contents decide which phrases count as terms."""

# Function words and hedges that no phrase may contain.
STOPWORDS = tuple("""
a an the of in on for to and or is are was were with without using use based new novel we propose present this paper show that by as
at from into via can be it its their our these those which
not only than rather does do did have has had will would could should may might must also both each such some many most more less
very just even still yet so then thus hence however while when where how why what who across between among within over under about
other another same different various several multiple existing prior current given here there them they
one two three four five six seven eight nine ten all any no first second third
similar similarly significant significantly largely broadly strongly highly notably notable substantially substantial considerably
considerable markedly marked effectively
""".split())

# Phrases of two words that are no terms.
STOP_BIGRAMS = tuple(x.strip() for x in """
we propose, we present, we show, we introduce, we study, we demonstrate, we find, we observe, in this, this paper, this work, our work,
experimental results, results show, results demonstrate, experiments demonstrate, experiments show, state of, of the, art performance,
extensive experiments, our method, our approach, our model, our framework, our results, recent work, prior work, future work, related work,
large language, language model, language models, deep learning, neural network, neural networks, machine learning, foundation models,
foundation model, training data, test set, test time, real world, wide range, significant improvement, significantly outperforms,
outperforms existing, existing methods, existing approaches, compared to, compared with, in terms, terms of, large scale, small scale,
case study, case studies, ablation study, ablation studies, human evaluation, empirical study, empirical results, open source,
code available, publicly available, github com, artificial intelligence, llm agents, llm agent, reinforcement learning, method achieves,
further introduce, strong performance, results highlight, methods typically, benchmarks demonstrate, increasingly used, widely used,
commonly used, further improves, benchmark dataset, benchmark datasets, downstream tasks, downstream task, test whether,
sufficient conditions, remains robust, proposed method, proposed framework, percentage points, typically rely, propose method,
novel method, novel approach, extensive evaluation, shows that, show that, demonstrate that, achieves state, compared existing,
promising results, consistently outperforms, achieve state, achieving state, remains challenging, still challenging, remains largely,
poorly understood, not well, lack of, address this, to address, key challenge, main challenge, propose novel, introduce novel,
present novel, high precision, positive correlation, negative correlation, controlled trials, clinical trials,
state-of-the-art performance, achieved state-of-the-art, vision-language models, retrieval-augmented generation
""".split(","))

# Words that report results; no phrase may contain one.
REPORTING_WORDS = tuple("""
results result indicate indicates indicated suggest suggests suggested demonstrate demonstrates demonstrated achieve achieves achieved
achieving outperform outperforms outperformed determine determines determined compared comparison
""".split())

# Acronyms too common to be news.
STOP_ACRONYMS = tuple("""
ai ml nlp llm llms vlm vlms api apis gpu gpus cpu cpus tpu tpus ram id ids iou sota roc auc fid psnr ssim cnn cnns rnn rnns lstm lstms
gan gans vae vaes gpt bert url urls html json csv pdf http https usa us uk eu iid ood rl cv os ui ux faq faqs todo eda svm svms knn pca
mlp mlps relu sgd adam bleu rouge meteor rest sql mri ct pet ecg eeg icu er who fda
neurips icml iclr cvpr eccv iccv acl emnlp naacl aaai ijcai kdd www sigir miccai auroc auprc mrr ndcg wer cer mae rmse mse
lda sparql mitre nvd icd cfr rss scl
""".split())

# Words by whose share English is told.
ENGLISH_MARKERS = tuple("the and of in a to is that for with as on are by this we an from at be it".split())

# Words that a saved search leaves out.
SEARCH_STOPWORDS = tuple("a an the of in on for to and or is are with using based via new novel approach method detection model models signal signals system systems".split())
